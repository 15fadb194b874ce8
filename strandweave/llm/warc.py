"""WARC archives with revisit records, and a globally ordered capture index merged from locally sorted runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fanout, new_path, stored

#: Bytes an archive file should have; readers take a file at a time.
FILE_BYTES = 8 << 20
#: Payloads shorter than this are stored each.
LEAST_REVISIT = 100
#: Seconds since 1970 of page 0's capture where a table has no capture times.
FIRST_CAPTURE = 1_704_067_200
#: Index entries that a task merges.
RANGE_ROWS = 100_000
#: What a revisit record of a payload with an equal digest names as its profile (fixed value of the format).
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header_safe(column: Column) -> Column:
    return F.regexp_replace(column, "[\\r\\n]", " ")


def _utc(seconds: Column) -> Column:
    """Seconds since 1970 as a UTC date and time, whatever the session's time zone: dates and numbers have none."""
    of_day = F.pmod(seconds, F.lit(86_400))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = [two(F.floor(of_day / 3600)), two(F.floor(of_day / 60) % 60), two(of_day % 60)]
    return F.concat(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string"), F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, date, payload, digest, payload_bytes, record_type, refers_to) for every page.

    Of pages with equal payloads of at least `least` bytes the one with the smallest id is the response and the others
    revisit it. Only digests and ids are shuffled to find them; the table joined back holds just the digests that repeat.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    raw = text.cast("binary")
    capture = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(10**9))
    date = F.coalesce(F.unix_seconds(F.col(date_col).cast("timestamp")), F.lit(FIRST_CAPTURE)) if date_col else capture
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), _utc(date).alias("date"), text.alias("payload"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("payload_bytes")
    )
    repeated = rows.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(stored(repeated, "repeated-payloads"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes one WARC record a row, in files of about `file_bytes`, through Spark's own writer.

    A record is its header, an empty line, its block and two line ends. A revisit has the payload's digest and length in
    its header and no block. Header values lose their line ends.
    """
    revisit = F.col("record_type") == "revisit"
    line = "\r\n"
    header = F.concat_ws(
        line,
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("record_type")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url"))), F.concat(F.lit("WARC-Date: "), F.col("date")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")), F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))),
    )
    n, total = records.agg(F.count("*"), F.sum("payload_bytes")).first()
    per_file = max(1, int(file_bytes // ((total or 0) / n + 400))) if n else 1
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    # The writer ends each row with the second line end.
    records.select(F.concat(header, F.lit(line + line), block, F.lit(line)).alias("value")).write.option("lineSep", line).option("maxRecordsPerFile", per_file).text(path)


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header, block) of each record; blocks are cut by their stated length, whatever they hold."""
    at = 0
    while at < len(content):
        split = content.index(b"\r\n\r\n", at)
        lines = content[at:split].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = split + 4
        end = start + int(header["Content-Length"])
        yield at, end + 4 - at, header, content[start:end]
        at = end + 4


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the last, lower-cased, without scheme and www; then path and query."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


RUN = "url_key string, captured string, page_id long, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back: each file becomes a run of index entries, sorted by URL key, capture time and page."""

    def ident(value: str) -> int | None:
        inner = value.removeprefix("<urn:page:").removesuffix(">")
        return None if inner == "none" else int(inner)

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                run = []
                for offset, length, header, block in parse_records(content.as_py()):
                    revisit = header["WARC-Type"] == "revisit"
                    size, digest = (int(header["X-Payload-Length"]), header["WARC-Payload-Digest"].split(":")[1]) if revisit else (len(block), hashlib.sha256(block).hexdigest())
                    if digest != header["WARC-Payload-Digest"].split(":")[1]:
                        raise ValueError(f"payload of {file} at {offset} does not match its digest")
                    page = ident(header["WARC-Record-ID"])
                    run.append((url_key(header["WARC-Target-URI"]), header["WARC-Date"], page, file.as_py(), offset, length, size, digest, header["WARC-Type"], ident(header["WARC-Refers-To"]) if revisit else None))
                run.sort(key=_order)
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in run], schema=ARROW)

    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInArrow(read, RUN)


NAMES = [c.split()[0] for c in RUN.split(", ")]
ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RUN.split(", ")])


def _order(entry: Sequence) -> tuple:
    key, captured, page = entry[:3]
    return key, captured, page is not None, page or 0, entry[3], entry[4]


class LoserTree:
    """k-way merge of sorted lists: inner nodes hold the losers of their matches, so the next entry costs one climb."""

    def __init__(self, runs: list[list], key=_order):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; exhausted runs come last, ties go to the lower run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _play(self, node: int) -> int:
        """Fills the losers below a node and returns its winner; node n has children 2n and 2n+1, leaves are n >= k."""
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.key(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            node, won = (run + k) // 2, run
            while node:
                if self._beats(self.losers[node], won):
                    self.losers[node], won = won, self.losers[node]
                node //= 2
            self.winner = won


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' entries in one global order, with capture_rank, the place in it from 0.

    The key space is cut into ranges of URL key, time and page, so a URL with many captures spans tasks. Each task gets
    its slice of every run, still sorted, and merges the slices with a loser tree.
    """
    spark = runs.sparkSession
    keys = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first()]
    ranges = max(fanout(spark), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("file", *keys, "offset")

    def merge(batches):
        slices: dict[str, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                slices.setdefault(row[3], []).append(row)
        task, held, place = TaskContext.get().partitionId(), [], 0
        schema = pa.schema([*ARROW, ("task", pa.int64()), ("place", pa.int64())])
        for row in LoserTree(list(slices.values())):
            held.append((*row, task, place))
            place += 1
            if len(held) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
                held = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)

    index = stored(dealt.mapInArrow(merge, RUN + ", task long, place long"), "captures")
    starts, at = [], 0
    for task, n in sorted(index.groupBy("task").agg(F.count("*")).collect()):  # a row a task
        starts.append((task, at))
        at += n
    offsets = spark.createDataFrame(starts, "task long, before long")
    return index.join(F.broadcast(offsets), "task").withColumn("capture_rank", F.col("before") + F.col("place")).drop("task", "place", "before")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Writes the pages' archives into the shared folder, reads them back and returns the merged index, a row a page.

    Null payloads are empty, null URLs the empty text, and a null id stands as it is (it revisits if its payload is
    another page's). Rows that repeat the smallest id of a payload are responses all. An empty table gives no rows;
    other columns are left out; payloads of any length are whole. Without `date_col` a page's capture time is
    FIRST_CAPTURE plus its id in seconds; a null date is FIRST_CAPTURE. Dates are written in UTC.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(plan_records(pages, id_col, url_col, payload_col, date_col), path)
    return merge_runs(stored(sorted_runs(spark, path), "runs"))
