"""WARC archives: a writer with revisit records, and a reader that verifies the chain of record boundaries.

Writing: pages with equal payloads share one response, that of the smallest id; the others become revisits. The archives are
plain WARC/1.1 files, written by Spark's text writer with the record separator as line separator, so they can lie on any file
system that Spark reaches, and a failed task leaves nothing behind.

Reading: Spark's text reader splits the files at the magic `WARC/1.1` CRLF wherever it occurs, in payloads too. One scan stores the
pieces, and chain and records follow from what it stored. Each task walks its splits and turns every occurrence into a candidate: its place in the split and, from its header's Content-Length, the place of its
successor. Chains within a split are contracted to their exit. Between splits, pointer jumping from the start of each file finds the
place where the true chain enters each split; only candidates on the chain from there are records. A record whose payload holds
the magic is put together from the pieces up to its successor. A chain that ends before the end of its file raises.

Nulls: a null html is an empty payload, a null url an empty target. A row with a null page id is a record too; null ids stand behind all
others. Of equal payloads exactly one row is the response: that of the smallest id, then of the smallest url; of rows that are equal in
all of this, one. The other rows revisit its id. An empty table gives no archive and no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import discard, staged, staging_path

MAGIC, GAP = "WARC/1.1\r\n", "\r\n\r\n"
_M = MAGIC.encode()
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")
#: Fixed values of RFC 4648: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(column):
    """Base32 of a digest given in hexadecimal, whose length is a multiple of five bytes."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(column, 10 * k + 1, 10), 16, 2), 40, "0") for k in range(4)))
    return F.concat(*(F.substring(F.lit(BASE32), (F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1), F.lit(1)) for k in range(32)))


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html", least: int = 0) -> str:
    """Archives of all pages in a new folder, whose path is returned. Payloads of fewer than `least` bytes are never revisits."""
    folder = folder or staging_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    each = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"),
                        F.sha1(payload.cast("binary")).alias("hex"), F.octet_length(payload).cast("long").alias("bytes"))
    each = each.withColumn("place", F.struct(F.col("id").isNull().alias("unnamed"), "id", "url"))
    grouped = each.where(F.col("bytes") >= least).groupBy("hex", "bytes")
    copies = staged(spark, grouped.agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    told = each.join(copies, ["hex", "bytes"], "left").withColumn("revisit", F.col("first").isNotNull() & (F.col("first") != F.col("place")))
    # rows that are equal in id, url and payload can all be the first: counted by task, one of them is the response
    firsts = told.where("first is not null and not revisit").groupBy("hex", "bytes", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    firsts = staged(spark, firsts)
    alike = staged(spark, firsts.groupBy("hex", "bytes").agg(F.sum("n").alias("all"), F.min("task").alias("task")).where("all > 1"))
    if not alike.isEmpty():
        equal = told.where("first is not null and not revisit").join(alike.select("hex", "bytes"), ["hex", "bytes"], "left_semi")
        response = equal.groupBy("hex", "bytes", "id", "url", "place", "first", "revisit").agg(F.first("payload").alias("payload"))
        again = firsts.join(alike, ["hex", "bytes", "task"], "left").join(alike.select("hex", "bytes", F.col("task").alias("holder")), ["hex", "bytes"])
        again = again.select("hex", "bytes", (F.col("n") - F.when(F.col("holder") == F.col("task"), 1).otherwise(0)).alias("n")).where("n > 0")
        again = again.join(copies, ["hex", "bytes"]).select("hex", "bytes", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"), "first")
        revisits = again.select("hex", "bytes", F.col("first.id").alias("id"), F.col("first.url").alias("url"), F.col("first").alias("place"), "first",
                                F.lit(True).alias("revisit"), F.lit("").alias("payload"))
        single = told.join(alike.select("hex", "bytes", F.lit(True).alias("shared")), ["hex", "bytes"], "left").where("shared is null or revisit").drop("shared")
        told = single.unionByName(response).unionByName(revisits)
    revisit = F.col("revisit")
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    clean = F.regexp_replace("url", r"[\r\n]+", "")
    fields = [
        (F.lit("WARC-Type"), F.when(revisit, "revisit").otherwise("response")), (F.lit("WARC-Record-ID"), F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        (F.lit("WARC-Target-URI"), clean), (F.lit("WARC-Date"), F.lit("1970-01-01T00:00:00Z")),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), base32_of_hex(F.col("hex")))), (F.lit("X-Payload-Length"), F.col("bytes").cast("string")),
        (F.lit("WARC-Refers-To"), F.when(revisit, F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.lit(">")))),
        (F.lit("WARC-Profile"), F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        (F.lit("Content-Type"), F.lit("text/html; charset=utf-8")), (F.lit("Content-Length"), F.octet_length(block).cast("string")),
    ]
    header = F.concat_ws("\r\n", *(F.concat(name, F.lit(": "), value) for name, value in fields))  # concat of null is null, which concat_ws leaves out
    told.select(F.concat(F.lit(MAGIC), header, F.lit(GAP), block).alias("value")).write.option("lineSep", GAP).text(folder)
    discard(spark, copies, firsts, alike)
    return folder


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, split, piece): what stands before the first magic of a file, then what follows each magic."""
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, place, piece) of all pieces; places count bytes from the split's first piece, each with a magic behind it."""
    held, place = None, 0
    for batch in batches:
        files, splits, pieces = batch.column(0), batch.column(1), batch.column(2)
        for i in range(batch.num_rows):
            key = files[i].as_py(), splits[i].as_py()
            if key != held:
                held, place = key, 0
            piece = pieces[i].as_buffer()
            yield *key, place, piece
            place += len(piece) + len(_M)


def _header(piece) -> tuple[int, int]:
    """Bytes of the header with its blank line and of the block; (0, 0) where there is no header."""
    head = bytes(piece[: 1 << 16])
    end = head.find(b"\r\n\r\n")
    if end < 0 and len(piece) > len(head):  # a header has no bound: urls can be long
        head = bytes(piece)
        end = head.find(b"\r\n\r\n")
    length = _LENGTH.search(head[: end + 2]) if end >= 0 else None
    return (end + 4, int(length[1])) if length else (0, 0)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places on the chain from a split's entry."""
    for batch in batches:
        for file, split, entry, places, successors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            follow, found, at = dict(zip(places, successors, strict=True)), [], entry
            while at in follow:
                found.append(at)
                at = follow[at]
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([found], pa.list_(pa.int64())), pa.array([at])], names=["file", "split", "places", "end"])


_SCANNED = pa.schema([("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("header", pa.binary()), ("block", pa.binary()), ("rest", pa.binary()), ("tail", pa.int64()),
                      ("total", pa.int64()), ("places", pa.list_(pa.int64())), ("successors", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
_COLUMNS = ("file string, split long, place long, header binary, block binary, rest binary, tail long, "
            "total long, places array<long>, successors array<long>, exits array<long>")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, and behind those of a split one with the places and successors of its candidates and their exits from it."""

    def split(key, places, successors, total):
        at = {p: i for i, p in enumerate(places)}
        exits = list(successors)
        for i in range(len(places) - 1, -1, -1):
            s = successors[i]
            if 0 <= s < total:
                exits[i] = exits[at[s]] if s in at else -1
        return (*key, None, None, None, None, None, total, places, successors, exits)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCANNED, strict=True)], schema=_SCANNED)

    rows: list[tuple] = []
    held, places, successors, total, weight = None, [], [], 0, 0
    for file, at_split, place, piece in _walk(batches):
        if (file, at_split) != held:
            if held:
                rows.append(split(held, places, successors, total))
            held, places, successors = (file, at_split), [], []
        header, block = _header(piece)
        data = bytes(piece)
        cut = header + block if header else len(data)
        rows.append((file, at_split, place, data[:header] if header else None, data[header:cut], data[cut:], block if header else -1, None, None, None, None))
        places.append(place)
        successors.append(place + len(_M) + header + block + len(GAP) if header else -1)
        total = place + len(piece) + len(_M)
        weight += len(data)
        if weight > 4 << 20:
            yield batch(rows)
            rows, weight = [], 0
    if held:
        yield batch([*rows, split(held, places, successors, total)])


def chain(spark: SparkSession, scanned: DataFrame) -> DataFrame:
    """(file, split, place) of the true records: candidates that the chain from the start of their file reaches."""
    splits = scanned.where("total is not null").select("file", "split", "total", "places", "successors", "exits")
    order = Window.partitionBy("file").orderBy("split")
    # the first piece of a file is what stands before its first magic: nothing. The first magic is at offset 0, so bases start there less one magic
    based = staged(spark, splits.select("file", "split", "total", (F.sum("total").over(order) - F.col("total") - len(_M)).alias("base")))
    links = (splits.join(based.drop("total"), ["file", "split"]).select("file", "base", F.explode(F.arrays_zip("places", "exits")).alias("c"))
             .select("file", (F.col("base") + F.col("c.places")).alias("at"), F.when(F.col("c.exits") >= 0, F.col("base") + F.col("c.exits")).alias("to")))
    goals = links.select("file", F.col("to").alias("at")).where("at is not null").distinct().unionByName(based.select("file", F.lit(0).cast("long").alias("at")).distinct()).distinct()
    jump = staged(spark, links.join(goals, ["file", "at"], "left_semi").where("to is not null"))
    reached = staged(spark, based.select("file", F.lit(0).cast("long").alias("at")).distinct())
    rounds = int(based.groupBy("file").count().agg(F.max("count")).first()[0] or 1).bit_length()
    for _ in range(rounds):
        reached = staged(spark, reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        further = jump.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jump = staged(spark, jump.join(further, ["file", "to"]).select("file", "at", F.col("next").alias("to")))
    entries = reached.join(based, "file").where("at >= base and at < base + total").select("file", "split", (F.col("at") - F.col("base")).alias("entry"), "base")
    walked = staged(spark, entries.join(splits, ["file", "split"]).select("file", "split", "entry", "places", "successors").mapInArrow(_chain, "file string, split long, places array<long>, end long"))
    ends = walked.join(based, ["file", "split"]).groupBy("file").agg(F.max(F.col("base") + F.col("end")).alias("end"))
    sizes = based.groupBy("file").agg(F.max(F.col("base") + F.col("total")).alias("size"))
    broken = sizes.join(ends, "file", "left").where("end is null or end != size").limit(1).collect()
    if broken:
        raise ValueError(f"the chain of records breaks off in {broken[0].file} at {broken[0].end} of {broken[0].size}")
    return walked.select("file", "split", F.explode("places").alias("place"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """file, header (text), payload (binary), payload_bytes and payload_hex (length and SHA-1 of the block) of every record."""
    # scanned once: the bounds of splits follow the number of executors, so a second scan could place the pieces otherwise
    kept = staging_path(spark)
    _pieces(spark, folder).mapInArrow(_scanned, _COLUMNS).write.option("compression", "zstd").parquet(kept)
    scanned = spark.read.schema(_COLUMNS).parquet(kept)
    found = staged(spark, chain(spark, scanned))
    pieces = scanned.where("total is null").select("file", "split", "place", "header", "block", "rest", "tail")
    ready = pieces.where(F.col("tail") == F.octet_length("block")).withColumn("hex", F.sha1("block"))
    whole = ready.join(found, ["file", "split", "place"]).select("file", "header", F.col("block").alias("payload"), "hex", F.col("tail").alias("payload_bytes"))
    cut = pieces.where(F.col("tail") > F.octet_length("block"))
    torn = staged(spark, cut.join(found, ["file", "split", "place"]).select("file", "split", "place"))
    if torn.isEmpty():
        return whole.select("file", F.col("header").cast("string").alias("header"), "payload", "payload_bytes", F.col("hex").alias("payload_hex"))
    # a record that goes on behind a magic in its payload: its own piece and the pieces up to the next record, in order
    starts = found.join(torn.select("file").distinct(), "file", "left_semi").withColumn("starts", F.lit(True))
    near = pieces.join(torn.select("file").distinct(), "file", "left_semi").join(starts, ["file", "split", "place"], "left").join(torn.withColumn("torn", F.lit(True)), ["file", "split", "place"], "left")
    inner = near.where("torn or starts is null").withColumn("piece", F.when(F.col("torn"), F.col("block")).otherwise(F.concat(F.coalesce("header", F.lit(b"")), "block", "rest")))
    ahead = Window.partitionBy("file").orderBy("split", "place")
    owned = inner.withColumn("owner", F.last(F.when(F.col("torn"), F.struct("split", "place", "header", "tail")), True).over(ahead)).where("owner is not null")
    joined = owned.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("split", "place", "piece"))).alias("parts"))
    block = F.aggregate(F.slice("parts", 2, 1 << 30), F.element_at("parts", 1)["piece"], lambda a, p: F.concat(a, F.lit(_M), p["piece"]))
    mended = joined.select("file", F.col("owner.header").alias("header"), F.substring(block, F.lit(1), F.col("owner.tail").cast("int")).alias("payload"), F.col("owner.tail").alias("payload_bytes"))
    both = whole.unionByName(mended.withColumn("hex", F.sha1("payload")).select(whole.columns))
    return both.select("file", F.col("header").cast("string").alias("header"), "payload", "payload_bytes", F.col("hex").alias("payload_hex"))


def field(name: str):
    """Value of a header's first field of this name; null where there is none or it is empty. Only CR LF ends a line."""
    return F.nullif(F.regexp_extract("header", rf"(?i)(?:\A|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?=\r\n|\z)", 1), F.lit(""))


def pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of records that `write` made; digests of responses are checked."""
    page = lambda name: F.nullif(F.regexp_extract(field(name), r"urn:page:(-?\d+)", 1), F.lit("")).cast("long")
    digest = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    kind = field("WARC-Type")
    own = base32_of_hex(F.col("payload_hex"))
    told = F.when((kind == "response") & (own != digest), F.raise_error(F.concat(F.lit("payload doesn't match its digest: "), field("WARC-Record-ID")))).otherwise(digest)
    return records.select(page("WARC-Record-ID").alias("page_id"), field("X-Payload-Length").cast("long").alias("payload_bytes"), told.alias("payload_digest"),
                          kind.alias("record_type"), page("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"))
