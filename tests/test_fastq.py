"""FASTQ records read by many tasks, cut at any byte, without moving what lies inside one."""

import random

import pytest

from strandweave.sources import text


@pytest.mark.parametrize("size", [211, 1000, 1 << 20])
def test_files_cut_at_any_byte(spark, tmp_path, size):
    r = random.Random(size)
    want, names = [], []
    for f, n in (("a", 60), ("b", 1), ("c", 17)):
        reads = [(i, "".join(r.choices("ACGT", k=r.choice([1, 5, 40, 200]))), f"BX{i}" if i % 3 else None) for i in range(n)]
        quals = ["".join(r.choices("@+I#", k=len(s))) for _, s, _ in reads]
        lines = [f"@r{f}{i}" + (f" BX:Z:{bx}" if bx else "") + f"\n{s}\n+\n{q}\n" for (i, s, bx), q in zip(reads, quals)]
        (tmp_path / f"{f}.fq").write_text("".join(lines))
        names.append(str(tmp_path / f"{f}.fq"))
        want += [(i, f"r{f}{i}", s, bx, q) for (i, s, bx), q in zip(reads, quals)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = text.read_fastq(spark, names)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = [(x.ord, x.name, x.seq, x.bx, x.qual) for x in rows.collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert plan.count("Exchange hashpartitioning") == 1  # that of the lines at the parts' ends


def test_cut_off_and_empty_files(spark, tmp_path):
    (tmp_path / "x.fq").write_text("@a\nAC\n+\nII\n@b\nGG\n+\nI\n@c\nTT\n")
    (tmp_path / "y.fq").write_text("")
    got = text.read_fastq(spark, [str(tmp_path / "x.fq"), str(tmp_path / "y.fq")]).collect()
    assert sorted((r.ord, r.name, r.seq, r.qual) for r in got) == [(0, "a", "AC", "II"), (1, "b", "GG", None), (2, "c", "TT", None)]
