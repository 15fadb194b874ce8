"""Files of markers: a barcode's line is put together from sorted rows, and read back without a shuffle of its markers."""

import random

import pytest

from strandweave.sources import sinks, text


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def unsigned(x):
    return x % (1 << 64)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lines_over_batches(spark, small_batches, kind):
    drawn = random.Random(3)
    # Barcodes of one row up to many batches, markers repeated, some of them over 2^63 as unsigned numbers.
    pairs = [(b, drawn.choice([-1, 1]) * drawn.randrange(3 * b + 2)) for b in range(20) for _ in range(1 + b * b % 23)] * 2
    name = (lambda b: b) if kind == "long" else (lambda b: f"bx{b}")
    rows = spark.createDataFrame([(name(b), m) for b, m in pairs], f"bx {kind}, mx long").repartition(5)
    expected = sorted(f"{name(b)}\t" + " ".join(str(unsigned(m)) for m in sorted({m for c, m in pairs if c == b})) for b in range(20))
    assert sorted(r.value for r in sinks.marker_lines(rows).collect()) == expected


def test_no_rows(spark):
    assert sinks.marker_lines(spark.createDataFrame([], "bx long, mx long")).collect() == []


def read(spark, tmp_path, lines):
    (tmp_path / "m.tsv").write_text(lines)
    return text.read_markers(spark, str(tmp_path / "m.tsv"))


def test_one_line_a_barcode_shuffles_nothing(spark, tmp_path):
    rows = read(spark, tmp_path, "a\t1 01 2:5 2:6 18137412081318970458\t\n b 3  1\nc\nd\t\n")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [("a", 18137412081318970458 - (1 << 64)), ("a", 1), ("a", 2), ("b", 1), ("b", 3)]


def test_lines_of_one_barcode(spark, tmp_path):
    assert sorted(map(tuple, read(spark, tmp_path, "a\t1 2\nb\t1\na\t2 3\n").collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_a_line_is_split_once(spark, tmp_path):
    rows = read(spark, tmp_path, "a\t1 2\n")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[: plan.index("Generate")]  # nothing above the rows of markers looks at the line
