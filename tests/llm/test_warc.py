import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandweave.llm.common import table
from strandweave.llm.warc import LoserTree, archive_and_index, parse_records, plan_records, sorted_runs, url_key, write_archives

from .helpers import SF, clashing


def odd_pages(spark):
    long = "x" * 150
    trap = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    rows = [(5, "http://a.b/c?d=1", long), (3, "http://a.b/c", long), (3, "http://a.b/c", long), (9, None, long), (None, "http://a.b", long), (1, "HTTP://WWW.A.b", None), (2, "", ""), (4, "bad\r\nurl: [", "short"), (6, "http://a.b/c", "short"), (7, "http://z.é/ü", trap), (8, "http://z.é/ü", trap), (10, "http://y", "ü" * 200_000), (11, "http://q", "a\r\n\r\nb\n\r")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    first = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 100 and r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        revisit = body in first and first[body] != r.page_id
        out.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(map(str, out))


def test_archives_round_trip(spark):
    for pages in (table(spark, SF, "pages"), clashing(odd_pages(spark), "id", "digest", "payload", "first", "offset", "file", "date")):
        got = archive_and_index(pages).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(pages.collect())
        ordered = sorted(got, key=lambda r: r.capture_rank)
        assert [r.capture_rank for r in ordered] == list(range(len(got)))
        keys = [(r.url_key, r.captured) for r in ordered]
        assert keys == sorted(keys)
    assert archive_and_index(pages.limit(0)).collect() == []


def test_records_are_found_at_their_offsets(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(plan_records(odd_pages(spark)), path, file_bytes=2000)
    runs = sorted_runs(spark, path).collect()
    assert len({r.file for r in runs}) > 1
    for r in runs:
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            (offset, length, header, block), = parse_records(f.read(r.length))
        assert length == r.length and (len(block) == r.payload_bytes or r.record_type == "revisit")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_are_utc_in_any_zone(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pages = spark.createDataFrame([(2, "http://a", "x", 1_700_000_000), (3, "http://b", "y", None), (4, "http://c", "z", -1)], "page_id long, url string, html string, at long")
        plain = {r.page_id: r.captured for r in archive_and_index(pages).collect()}
        assert plain == {2: "2024-01-01T00:00:02Z", 3: "2024-01-01T00:00:03Z", 4: "2024-01-01T00:00:04Z"}
        dated = archive_and_index(pages.withColumn("at", F.timestamp_seconds("at")), date_col="at").collect()
        assert {r.page_id: r.captured for r in dated} == {2: "2023-11-14T22:13:20Z", 3: "2024-01-01T00:00:00Z", 4: "1969-12-31T23:59:59Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_revisits_name_their_profile(spark, tmp_path):
    path = str(tmp_path / "warc")
    write_archives(plan_records(odd_pages(spark)), path)
    headers = [h for f in Path(path).glob("part-*") for _, _, h, _ in parse_records(f.read_bytes())]
    assert len(headers) == 13 and all((h["WARC-Type"] == "revisit") == ("WARC-Profile" in h) for h in headers)


def test_ranges_are_bounded_by_rows(spark, monkeypatch):
    from strandweave.llm import warc

    monkeypatch.setattr(warc, "RANGE_ROWS", 10)
    pages = table(spark, SF, "pages")
    got = sorted(archive_and_index(pages).collect(), key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in got] == list(range(pages.count())) and [(r.url_key, r.captured) for r in got] == sorted((r.url_key, r.captured) for r in got)


def test_loser_tree_merges():
    seeded = random.Random(2)
    for k in range(9):
        runs = [sorted(seeded.randrange(20) for _ in range(seeded.randrange(8))) for _ in range(k)]
        assert list(LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("https://www.Example.com/a?b#c") == "com,example)/a?b" and url_key("http://x.y") == "y,x)/"
