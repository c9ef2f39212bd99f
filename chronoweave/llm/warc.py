"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are written and read by Spark's text source with a record separator, which is byte-exact, splits
large files and works in any store Spark reaches. On reading, every magic line in a split is a candidate:
its header names the offset of its successor. Magic can also stand inside a payload, so candidates prove
nothing by themselves; pointer jumping from the start of each file (pointers double in reach each round)
keeps those that the chain of successors reaches. A payload that holds magic was cut by the reader and is
put together again from its segments.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace, broadcast_if_small

MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads of at least so many bytes are written once; equal ones revisit the first.
LEAST_REVISIT = 0


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight times twenty bits are four characters."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, ws: Workspace, least_revisit: int = LEAST_REVISIT) -> str:
    """A record per page; returns the archives' folder. Only digests are shuffled, unless more payloads are repeated
    than may be broadcast; then pages and the first of their kind meet in a merge join."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html"), "mark": F.xxhash64("html")})
    key = ["sha", "size", "mark"]
    first = own.where(F.col("size") >= least_revisit).groupBy(*key).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    first = ws.stage(first, "first")
    own = own.join(broadcast_if_small(first), key, "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20]", "%20")
    block = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    extra = F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")), F.lit("\r\n"))).otherwise("")
    record = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), url, F.lit("\r\n"), extra,
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha")), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )
    where = ws.path("archives")
    own.select(record.alias("value")).write.option("lineSep", _END).text(where)
    return where


def _segments(spark, path: str) -> DataFrame:
    """What stands between magic lines: value, with file, block and row for its place."""
    read = spark.read.option("lineSep", MAGIC).text(path)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """Header fields, and the payload's digest and size if the block is whole in value (which lacks its magic)."""
    head = F.substring_index(value, _END, 1)
    http = F.substring_index(value, _END, 2)
    head_size = F.octet_length(head) + 4
    length = F.expr("0").cast("long") + F.coalesce(_field(head, "Content-Length").try_cast("long"), F.lit(-1))
    before = F.when(_field(head, "Content-Type").startswith("application/http"), F.octet_length(http) + 4).otherwise(head_size)
    size = head_size + length - before
    payload = F.substring(value.cast("binary"), (before + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    whole = (length >= 0) & (F.octet_length(value) >= head_size + length)
    return {
        "to": F.when(length >= 0, F.lit(len(MAGIC)) + head_size + length + 4),
        "kind": _field(head, "WARC-Type"), "id": _field(head, "WARC-Record-ID"), "refers": _field(head, "WARC-Refers-To"),
        "stated": F.regexp_extract(F.coalesce(_field(head, "WARC-Payload-Digest"), F.lit("")), "^sha1:(.*)$", 1), "stated_size": _field(head, "X-Payload-Length").try_cast("long"),
        "whole": whole, "payload_size": F.when(whole, size), "payload_sha": F.when(whole, F.sha1(payload)),
    }


def candidates(ws: Workspace, path: str) -> DataFrame:
    """A row per magic line: file, at (its offset), to (its successor's), header fields, place in the scan."""
    scanned = _segments(ws.spark, path)
    scanned = scanned.select("file", "block", "row", (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"), *(c.alias(n) for n, c in _parsed(F.col("value")).items()))
    scanned = ws.stage(scanned, "scanned")
    blocks = scanned.groupBy("file", "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ws.stage(blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "blocks")
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.withColumn("in_block", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(broadcast_if_small(blocks), ["file", "block"])
    # a segment follows its magic; the first one of a file is what stands before any
    placed = placed.withColumn("at", F.col("base") + F.col("in_block") - len(MAGIC)).where("at >= 0")
    return ws.stage(placed.withColumn("to", F.col("at") + F.col("to")).drop("base", "in_block"), "candidates")


def reachable(ws: Workspace, found: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain that begins at each file's start."""
    jump = ws.stage(found.join(found.select("file", F.col("at").alias("to")), ["file", "to"]).select("file", "at", "to"), "jumps")
    reached = ws.stage(found.where("at = 0").select("file", "at"), "reached")
    while True:
        more = ws.stage(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")), "more")
        if not more.count():
            return reached
        reached = ws.stage(reached.union(more), "reached")
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = ws.stage(jump.join(further, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")


@contextmanager
def _equal_splits(spark):
    """Scans of the same files are split alike in here, however many executors come and go: the least number of
    splits is fixed, which else follows the cores at hand."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


_FIELDS = ("id", "kind", "refers", "stated", "stated_size", "payload_size", "payload_sha")


def read(ws: Workspace, path: str) -> DataFrame:
    """A row per record: id, kind, refers, payload_bytes, payload_digest, of the full payload.

    Revisits take size and digest from their headers, responses from their bytes. Records that were cut at
    magic in their payload are read in a second scan with the same splits; if it doesn't give every segment
    of the first one again, that is an error.
    """
    with _equal_splits(ws.spark):
        found = candidates(ws, path)
        real = reachable(ws, found).withColumn("real", F.lit(True))
        marked = ws.stage(found.join(real, ["file", "at"], "left").withColumn("real", F.coalesce("real", F.lit(False))), "marked")
        out = marked.where("real and whole").select(*_FIELDS)
        cut = marked.where("not real or not whole").select("file", "block", "row", "at", "real")
        if cut.limit(1).count():
            # a record and the segments after it that the chain doesn't reach are one
            order = Window.partitionBy("file").orderBy("at")
            cut = ws.stage(cut.withColumn("owner", F.last(F.when(F.col("real"), F.col("at")), ignorenulls=True).over(order)).where("owner is not null"), "cut")
            pieces = _segments(ws.spark, path).join(broadcast_if_small(cut), ["file", "block", "row"])
            whole = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
            value = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
            again = whole.select(F.size("parts").alias("n"), value.alias("value"))
            again = ws.stage(again.select("n", *(c.alias(n) for n, c in _parsed(F.col("value")).items())), "again")
            if (again.agg(F.sum("n")).head()[0] or 0) != cut.count():
                raise RuntimeError("the archives were split differently in the second scan; some cut records were not found again")
            out = out.union(again.where("whole").select(*_FIELDS))
    own = F.col("kind") != "revisit"
    return out.select("id", "kind", "refers", F.when(own, F.col("payload_size")).otherwise(F.col("stated_size")).cast("long").alias("payload_bytes"), F.when(own, base32(F.col("payload_sha"))).otherwise(F.col("stated")).alias("payload_digest"))


def round_trip(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; empty payloads are equal like others. A null page_id is written as a
    response and returned as null. Rows that repeat the smallest page_id of equal payloads are responses all,
    as none is larger. Control characters in a url become %20; a null url is about:blank. An empty table
    gives an empty result.
    """
    ws = Workspace(pages.sparkSession, "warc")
    records = read(ws, write(pages, ws, least_revisit))
    number = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return records.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers").alias("refers_to"))
