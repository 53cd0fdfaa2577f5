"""WARC records and a Merkle fixity audit of two replicas.

Records are ordered by id. A record's slot is its id; 256 neighbouring slots make a range, 256 neighbouring ranges a wider one,
and so on up to the root. A leaf hashes a record's bytes. An inner node hashes, in order, each child's position, the range of
bytes that it takes (from where to where, counted from the node's own beginning) and its hash; so the root vouches for the
records and for where each of them lies. Two replicas are compared from the root down, and only the children of nodes that
differ (or that one replica lacks) are read, which ends at the damaged records.

All levels are keyed by id ranges and count offsets from their own beginning, so a lost or shortened record changes its own
branch and doesn't shift its neighbours.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: Ids in a segment (one archive file) as a power of two, children of a node as one, and levels of nodes above the leaves.
SEGMENT_BITS, FAN_BITS, LEVELS = 10, 8, 4


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC response record of a page; a null url or page counts as empty."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def leaves(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (slot, segment, offset, length, records, hash): one leaf for each id, null ids dropped.

    Records that share an id make one leaf, whatever their order: its hash is that of their number and of the sums of four parts
    of their hashes, which partial sums give, so that an id may have any number of records. offset counts bytes from the
    segment's beginning.
    """
    rec = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("slot"), record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    one = rec.select("slot", F.sha2(F.col("r").cast("binary"), 256).alias("hash"), F.octet_length("r").cast("long").alias("length"))
    lanes = [F.sum(F.conv(F.substring("hash", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    leaf = one.groupBy("slot").agg(F.sum("length").alias("length"), F.count("*").alias("records"), F.min("hash").alias("hash"), F.concat_ws(":", F.count("*").cast("string"), *lanes).alias("many"))
    w = Window.partitionBy("segment").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    leaf = leaf.withColumn("hash", F.when(F.col("records") > 1, F.sha2(F.col("many").cast("binary"), 256)).otherwise(F.col("hash"))).withColumn("segment", F.shiftright("slot", SEGMENT_BITS))
    return leaf.select("slot", "segment", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"), "length", "records", "hash")


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Nodes (node, parent, length, hash) of each level, leaves first; a node's number is its children's, shifted right, and its length the sum of theirs. The last level holds what LEVELS shifts leave: few nodes, one for ids below 2**32."""
    up = lambda c: F.shiftright(c, FAN_BITS)
    levels = [stored(leaf.select(F.col("slot").alias("node"), up("slot").alias("parent"), "length", "hash"), "level0")]
    for k in range(LEVELS):
        kids = F.array_sort(F.collect_list(F.struct("node", "length", "hash")))  # 2**FAN_BITS at most
        line = lambda s, x: F.concat(s["told"], x["node"].cast("string"), F.lit(":"), s["at"].cast("string"), F.lit("-"), (s["at"] + x["length"]).cast("string"), F.lit(":"), x["hash"], F.lit("\n"))
        told = F.aggregate(kids, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("told")), lambda s, x: F.struct((s["at"] + x["length"]).alias("at"), line(s, x).alias("told")))
        node = levels[-1].groupBy(F.col("parent").alias("n")).agg(told.alias("t"))
        levels.append(stored(node.select(F.col("n").alias("node"), up("n").alias("parent"), F.col("t.at").alias("length"), F.sha2(F.col("t.told").cast("binary"), 256).alias("hash")), f"level{k + 1}"))
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(slot, expected, found) of the leaves that differ: null where a replica lacks the record. Reads children of differing nodes only."""
    bad = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if bad is not None:
            over = bad.select(F.col("slot").alias("parent"))
            a, b = a.join(over, "parent", "left_semi"), b.join(over, "parent", "left_semi")
        both = a.select("node", F.col("hash").alias("expected")).join(b.select("node", F.col("hash").alias("found")), "node", "full")
        bad = stored(both.filter(~F.col("expected").eqNullSafe(F.col("found"))).select(F.col("node").alias("slot"), "expected", "found"), "bad")
    return bad


def fixity(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, segment, offset, length, expected, found, status) for every id of either replica; status is ok, changed, missing (in the replica) or extra (offset and length are null).

    Null ids are dropped; repeated rows count as records of one leaf. Two empty replicas give an empty result.
    """
    leaf = stored(leaves(primary), "leaves")
    bad = audit(tree(leaf), tree(leaves(replica)))
    out = leaf.join(bad.withColumn("hit", F.lit(True)), "slot", "full")
    status = F.when(F.col("hit").isNull(), "ok").when(F.col("hash").isNull(), "extra").when(F.col("found").isNull(), "missing").otherwise("changed")
    found = F.when(F.col("hit").isNull(), F.col("hash")).otherwise(F.col("found"))
    return out.select(F.col("slot").alias("page_id"), F.shiftright("slot", SEGMENT_BITS).alias("segment"), "offset", "length", F.col("hash").alias("expected"), found.alias("found"), status.alias("status"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write the records as gzip text files, a segment in one file, in order: each begins at the offset that `leaves` says, in the uncompressed file."""
    rec = pages.filter("page_id is not null").select(F.col("page_id").cast("long").alias("slot"), record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    # The writer ends each value with the line separator, which is a record's last character.
    rec = rec.select("slot", F.shiftright("slot", SEGMENT_BITS).alias("segment"), F.expr("substring(r, 1, char_length(r) - 1)").alias("value")).repartition("segment").sortWithinPartitions("segment", "slot", "value")
    rec.select("segment", "value").write.partitionBy("segment").option("lineSep", "\n").text(path, compression="gzip")


class _Inflated(io.RawIOBase):
    """The bytes of gzip members (or plain ones) as far as they can be read: damage or a missing end is the end."""

    def __init__(self, data: bytes):
        self.left, self.zip = memoryview(data), zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, b: bytearray) -> int:
        while True:
            if self.zip is None:
                got, self.left = bytes(self.left[: len(b)]), self.left[len(b) :]
            else:
                if self.zip.eof:
                    rest = self.zip.unused_data + bytes(self.left)
                    self.left, self.zip = memoryview(rest), zlib.decompressobj(31)
                piece = self.zip.unconsumed_tail or bytes(self.left[:65_536])
                if not self.zip.unconsumed_tail:
                    self.left = self.left[65_536:]
                try:
                    got = self.zip.decompress(piece, len(b))
                except zlib.error:
                    self.left, got = self.left[:0], b""
                    piece = b""
                if not got and piece:
                    continue
            b[: len(got)] = got
            return len(got)


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, body) of every whole record in a WARC file, gzip members or plain, one after another.

    offset counts uncompressed bytes. A record that the file's end or damage cuts short, and one whose Content-Length is no number
    from 0, are left out; reading goes on at the next line that begins a record.
    """
    f, at = io.BufferedReader(_Inflated(data), 1 << 16), 0

    def line() -> bytes:
        nonlocal at
        x = f.readline()
        at += len(x)
        return x

    while x := line():
        if not x.startswith(b"WARC/"):
            continue
        begin, headers = at - len(x), {}
        while (x := line().rstrip(b"\r\n")) and b":" in x:
            k, _, v = x.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = headers.get("content-length", "")
        if not (n.isascii() and n.isdigit()):
            continue
        body = bytearray()
        while len(body) < int(n) and (x := f.read(min(1 << 20, int(n) - len(body)))):
            body += x
        at += len(body)
        if len(body) == int(n):
            yield begin, headers, bytes(body)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, offset, type, uri, body) of the whole records in the WARC files at path. A file is one task's work: its compressed bytes must fit the task's memory, records are handed on 64 at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "record", "offset", "type", "uri", "body"]
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows: list[tuple] = []
                for k, (at, h, body) in enumerate(records(bytes(c))):
                    rows.append((p, k, at, h.get("warc-type"), h.get("warc-target-uri"), body))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, record long, offset long, type string, uri string, body binary")
