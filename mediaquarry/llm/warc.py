"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing goes through Spark's text sink with the record separator as line separator, so archives lie in
any store Spark writes to and no task holds more than a record. Records with a payload that occurs again
(by SHA-1 and length) are one response, of least page_id, and revisits of it.

Reading splits the archives at every occurrence of the magic "WARC/1.", inside payloads too. The pieces
are written once, with their bytes, and all later steps read that table: what names a piece (file, split,
place in the split) is then the same for all of them, however the cluster changes meanwhile. A piece that
goes on with a version, "0" or "1" and a line end, is a candidate record; its header names its successor's
offset. The pieces of a file must add up to its length, or reading fails. Plain files are read in splits;
gzipped ones, also of a member a record, by a task a file. Tasks compose the successors
inside their split to one jump out of it; pointer jumping over the splits, in as many rounds as the
logarithm of a file's splits, then finds where the chain from the file's start enters each split, and
only records on that chain are kept. Pieces that magic inside a payload has cut off are joined again.

Defined results: a null page has an empty payload; a null url or page_id is left out of the record and
read as null; control characters in a url are percent-encoded; rows that repeat the least page_id of a
payload are all responses; a chain that breaks (a damaged header or length) ends there, with the
records before it kept; an empty table gives an empty archive; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, groups, small, table

MAGIC = "WARC/1."
END = "\r\n\r\n"
MIN_BYTES, PER_FILE = 0, 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: forty bits, ten hex digits, are eight of its digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _clean_url(url: Column) -> Column:
    for code in (9, 10, 13):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.regexp_replace(url, r"[\x00-\x1F\x7F]", "%00")


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes (page_id, url, html) as WARC records under path."""
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body.cast("binary")).alias("digest"))
    scratch = Scratch(pages.sparkSession, "revisits")
    again = p.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    p = p.join(small(scratch.write(again, "again")), ["digest", "bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    lines = [
        F.lit(MAGIC + "1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Target-URI", _clean_url(F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, _header("WARC-Refers-To", _record_id(F.col("first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        _header("Content-Length", F.octet_length(block).cast("string")),
    ]
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)
    p.select(value.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", PER_FILE).text(path)


def _field(head: Column, name: str, pattern: str = r"[^\r\n]*") -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*({pattern})", 1)
    return F.when(found != "", found)


def _exits(batches):
    """In each split: the first offset at or behind its end that the chain from a candidate reaches."""
    import numpy as np
    import pyarrow as pa

    for _, t in groups(batches, ["file", "block"]):
        off, to, end = t.column("off").to_numpy(), t.column("next").to_numpy(zero_copy_only=False), t.column("till")[0].as_py()
        order = np.argsort(off)
        out: dict[int, int | None] = {}
        for k in order[::-1].tolist():
            n = to[k]
            out[int(off[k])] = None if n != n or n <= off[k] else int(n) if n >= end else out.get(int(n))
        keep = t.select(["file", "block", "off"])
        keep = keep.append_column("exit", pa.array([out[int(o)] for o in off], pa.int64()))
        yield from keep.combine_chunks().to_batches()


def _walk(batches):
    """In each split: marks the candidates on the chain from its entry, and their pieces' owner."""
    import numpy as np
    import pyarrow as pa

    for _, t in groups(batches, ["file", "block"]):
        off, to = t.column("off").to_numpy(), t.column("next").to_numpy(zero_copy_only=False)
        at = t.column("entry")[0].as_py()
        on, where = np.zeros(len(off), dtype=bool), {int(o): k for k, o in enumerate(off)}
        while at is not None and at in where:
            k = where[at]
            if to[k] != to[k] or to[k] <= at:
                break
            on[k] = True
            at = int(to[k])
        yield from t.drop_columns(["entry", "till"]).append_column("on", pa.array(on)).combine_chunks().to_batches()


def pieces_of(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The archive cut at every magic, written: (file, block, seq, value, bytes); seq orders the pieces of a split."""
    meta = lambda name: F.col(f"_metadata.{name}")
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value", F.octet_length("value").cast("long").alias("bytes"), meta("file_size").alias("file_size"))
    pieces = scratch.write(raw, "pieces")
    # the last piece of a file has no magic behind it, unless the file ends with one
    held = pieces.groupBy("file").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("n"), F.max("file_size").alias("size"))
    bad = held.filter((F.col("n") != F.col("size")) & (F.col("n") != F.col("size") + len(MAGIC)) & ~F.lower("file").rlike(r"\.(gz|gzip)$")).first()
    if bad:
        raise RuntimeError(f"{bad.n} of {bad.size} bytes of {bad.file} have been read")
    return pieces.drop("file_size")


def chain(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, block, seq, owner, part): the pieces of true records; owner is the record's offset."""
    head = F.substring_index(F.col("value"), END, 1)
    whole = F.col("value").rlike(r"^[01]\r\n") & (F.instr(F.col("value"), END) > 0)
    length = F.expr("try_cast(length as long)")
    light = pieces.select("file", "block", "seq", "bytes", F.when(whole, F.octet_length(head).cast("long") + 4).alias("head"), F.when(whole, _field(head, "Content-Length", r"\d+")).alias("length"))
    light = scratch.write(light.withColumn("length", length), "heads")
    step = len(MAGIC)
    splits = light.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("sum"))
    to = Window.partitionBy("file").orderBy("block")
    splits = splits.withColumn("till", F.sum("sum").over(to)).select("file", "block", (F.col("till") - F.col("sum")).alias("from"), (F.col("till") - step).alias("till"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spot = light.join(small(splits), ["file", "block"]).withColumn("off", F.col("from") + F.coalesce(F.sum(F.col("bytes") + step).over(within), F.lit(0)) - step)
    spot = spot.filter("off >= 0").withColumn("next", F.col("off") + step + F.col("head") + F.col("length") + 4)
    spot = scratch.write(spot.select("file", "block", "seq", "off", "next", "till"), "candidates")
    by = ["file", "block"]
    jumps = spot.repartition(*by).sortWithinPartitions(*by).mapInArrow(_exits, "file string, block long, off long, exit long")
    jumps = scratch.write(jumps, "jumps")
    entry = scratch.write(jumps.groupBy("file").agg(F.min("off").alias("off")).filter("off = 0"), "entries")
    hop = jumps.select("file", "off", F.col("exit").alias("to")).filter("to is not null")
    if jumps.groupBy("file").agg(F.count_distinct("block").alias("n")).filter("n > 1").limit(1).count():
        while True:
            reached = entry.join(hop, ["file", "off"]).select("file", F.col("to").alias("off"))
            more = scratch.write(entry.unionByName(reached).distinct(), "entries")
            if more.count() == entry.count():
                break
            entry = more
            far = hop.select("file", F.col("off").alias("to"), F.col("to").alias("further"))
            hop = scratch.write(hop.join(far, ["file", "to"]).select("file", "off", F.col("further").alias("to")), "hops")
    starts = entry.join(jumps.select("file", "block", "off"), ["file", "off"]).select("file", "block", F.col("off").alias("entry"))
    walked = spot.join(small(starts), by, "left").repartition(*by).sortWithinPartitions(*by).mapInArrow(_walk, "file string, block long, seq long, off long, next long, on boolean")
    walked = scratch.write(walked, "walked")
    # a piece belongs to the record its offset lies in; that record may start in an earlier split
    inside = Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("off", "next")
    per = walked.groupBy("file", "block").agg(F.max(F.when(F.col("on"), own)).alias("m"))
    per = per.select("file", "block", F.max("m").over(last).alias("carried"))
    owned = walked.withColumn("o", F.max(F.when(F.col("on"), own)).over(inside)).join(small(per), by).withColumn("o", F.coalesce("o", "carried"))
    return owned.filter(F.col("o.next") > F.col("off")).select("file", "block", "seq", F.col("o.off").alias("owner"), (~F.col("on")).alias("part"), "off")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: (file, offset, type, record_id, url, refers_to, digest, http_bytes, payload binary, intact)."""
    scratch = Scratch(spark, "warc")
    pieces = pieces_of(spark, path, scratch)
    owned = scratch.write(chain(pieces, scratch), "owned")
    cut = owned.filter("part").select("file", "owner").distinct()
    owned = owned.join(small(cut.withColumn("many", F.lit(True))), ["file", "owner"], "left")
    got = pieces.join(small(owned), ["file", "block", "seq"])
    single = got.filter("many is null").select("file", "owner", "value")
    split = got.filter("many").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("v")).select("file", "owner", F.array_join(F.col("v.value"), MAGIC).alias("value"))
    both = single.unionByName(split)
    head = F.substring_index(F.col("value"), END, 1)
    rest = F.col("value").cast("binary")
    size = F.expr("try_cast(size as long)")
    recs = both.select("file", F.col("owner").alias("offset"), head.alias("head"), _field(head, "Content-Length", r"\d+").alias("size"), rest.alias("raw")).withColumn("size", size)
    recs = recs.withColumn("block", F.expr("substring(raw, octet_length(head) + 5, cast(size as int))"))
    recs = recs.withColumn("http", F.substring_index(F.col("block").cast("string"), END, 1))
    payload = F.expr("substring(block, octet_length(http) + 5)")
    out = recs.select(
        "file", "offset", _field(F.col("head"), "WARC-Type").alias("type"), _field(F.col("head"), "WARC-Record-ID").alias("record_id"), _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"), _field(F.col("head"), "WARC-Payload-Digest").alias("digest"), _field(F.col("http"), "Content-Length", r"\d+").alias("http_bytes"),
        payload.alias("payload"),
    )
    intact = F.when(F.col("type") == "revisit", F.lit(True)).otherwise((F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))) == F.col("digest")))
    return out.withColumn("http_bytes", F.expr("try_cast(http_bytes as long)")).withColumn("intact", F.coalesce(intact, F.lit(False)))


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def op2_warc_roundtrip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = Scratch(spark, "archive").fresh("warc")
    write_warc(pages, path)
    r = read_warc(spark, path)
    size = F.when(F.col("type") == "revisit", F.col("http_bytes")).otherwise(F.octet_length("payload").cast("long"))
    return r.select(_page(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), F.substring("digest", 6, 32).alias("payload_digest"), F.col("type").alias("record_type"), _page(F.col("refers_to")).alias("refers_to"), "intact")


SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
d AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hexed, i // 8 * 10 + 1, 10))::BIGINT >> (35 - i % 8 * 5)) & 31) + 1 AS BIGINT), 1)
                             for i in range(32)], '') AS digest,
         min(page_id) OVER (PARTITION BY hexed, bytes) AS head FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to, true AS intact
FROM d
"""
