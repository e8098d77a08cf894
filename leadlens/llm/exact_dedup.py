"""Exact deduplication by Grace hashing: records go to buckets by a hash of their content, buckets
that are too large are partitioned again, and a bucket that fits is compared in an open-addressing
table on complete content.

1. Each task lower-cases A-Z and folds its own copies in such a table (flushed at ``TABLE_BYTES`` of
   distinct content), so a text that a third of all rows hold leaves a task once per table, as one
   *record* with its count and largest doc_id.  Documents and records are written once.
2. The records' bytes give the number of buckets.  Buckets over ``LEAF_BYTES`` are known from an
   aggregation over narrow columns before any content moves.  They are spilled to a written table
   under a further hash; a bucket that holds copies of one content only, which no hash can part, is
   cut by record number instead and its pieces are folded, until all buckets fit.
3. A fitting bucket is one group: the table compares whole contents and names each record's class.

Written tables in the shared checkpoint folder are the spill files; a lost executor repeats its
tasks only.  Document rows return to their class by the number of their record, which repeats at
most once per row of one task's table.

Defined results: a null text is the empty text; classes are made over all rows, repeated rows and
rows with a null doc_id included, and ``group_size`` counts them all.  The row with the largest
doc_id stays (nulls are least); of several rows with that doc_id and text exactly one stays.  A
group without any doc_id has a null ``keep_id`` and one row that stays.  Texts of any length are
compared whole; a content larger than a bucket is a bucket of its own.  An empty table gives an
empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import materialize

from .common import column, dealt_by_bytes, materialize_texts, slices, table, texts, utf8

TABLE_BYTES = 32 << 20
TABLE_ROWS = 200_000
LEAF_BYTES = 32 << 20
ROW_BYTES = 200  # what a record costs besides its content
BATCH_BYTES = 8 << 20
TASK_BYTES = 128 << 20
BROADCAST_BUCKETS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RECORDS = "rec long, doc_id long, digest binary, best boolean, h long, n long, size long, content binary"
_CLASSES = "rec long, rep long, n long, top long, h long, size long, content binary"


class ContentTable:
    """Open addressing with linear probing; an entry is found by its whole content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        """The number of the entry that holds ``content``, added if it is new."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        slots[at] = entry = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        slots = self.slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


def _above(a: int | None, b: int | None) -> bool:
    """a is the larger doc_id, nulls least."""
    return a is not None and (b is None or a > b)


def _batches(rows: dict[str, list], schema: str) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded content."""
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    sizes = [64 + len(c or b"") for c in rows["content"]]
    lo = 0
    while lo < len(sizes):
        hi, held = lo, 0
        while hi < len(sizes) and (hi == lo or held + sizes[hi] <= BATCH_BYTES):
            held += sizes[hi]
            hi += 1
        yield pa.RecordBatch.from_arrays([pa.array(rows[n][lo:hi], kinds[t]) for n, t in fields], names=[n for n, _ in fields])
        lo = hi


def records(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: its record's number and the digest of its normalised text.  The row
    that stands for the record (``best``) also holds the content and the record's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held = ContentTable()
        entries: list[int] = []
        ids: list[int | None] = []
        digests: list[bytes] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, entries, ids, digests
            best: list[int] = [-1] * len(held.contents)
            count = [0] * len(held.contents)
            for row, entry in enumerate(entries):
                count[entry] += 1
                if best[entry] < 0 or _above(ids[row], ids[best[entry]]):
                    best[entry] = row
            stands = [best[entry] == row for row, entry in enumerate(entries)]
            yield from _batches({
                "rec": [first + e for e in entries], "doc_id": ids, "digest": digests, "best": stands,
                "h": [held.hashes[e] for e in entries], "n": [count[e] for e in entries],
                "size": [len(held.contents[e]) for e in entries],
                "content": [held.contents[e] if s else None for e, s in zip(entries, stands)]}, _RECORDS)
            first += len(held.contents)
            held, entries, ids, digests = ContentTable(), [], [], []

        for batch in batches:
            text = texts(batch)
            for lo, hi in slices(text):
                raw, offsets = utf8(text.slice(lo, hi - lo))
                low, at = _LOWER[raw].tobytes(), offsets.tolist()
                for doc_id, a, b in zip(column(batch, "doc_id").slice(lo, hi - lo).to_pylist(), at[:-1], at[1:]):
                    content = low[a:b]
                    digest = hashlib.sha256(content).digest()
                    entries.append(held.place(int.from_bytes(digest[:8], "little", signed=True), content))
                    ids.append(doc_id)
                    digests.append(digest)
                if held.bytes > table_bytes or len(entries) >= TABLE_ROWS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, _RECORDS)


def _compare(with_content: bool):
    """One bucket in memory: each record and the record that stands for its class."""

    def run(bucket: pa.Table) -> pa.Table:
        held = ContentTable()
        content = bucket.column("content")
        entries = [held.place(h, c.as_py()) for h, c in zip(bucket.column("h").to_pylist(), content)]
        rec, n, top = (bucket.column(c).to_pylist() for c in ("rec", "n", "top"))
        best: list[int] = [-1] * len(held.contents)
        total = [0] * len(held.contents)
        for row, entry in enumerate(entries):
            total[entry] += n[row]
            b = best[entry]
            if b < 0 or _above(top[row], top[b]) or (top[row] == top[b] and rec[row] < rec[b]):
                best[entry] = row
        stands = [with_content and best[e] == row for row, e in enumerate(entries)]
        return pa.Table.from_batches(_batches({
            "rec": rec, "rep": [rec[best[e]] for e in entries], "n": [total[e] for e in entries],
            "top": [top[best[e]] for e in entries], "h": [held.hashes[e] for e in entries],
            "size": [len(held.contents[e]) for e in entries],
            "content": [held.contents[e] if s else None for e, s in zip(entries, stands)]}, _CLASSES))

    return run


def classes(found: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(rec, rep, n, top): for each record of :func:`records` the record that stands for all with its
    content, their number of rows and their largest doc_id."""
    pending = found.filter("best").select("rec", "h", "n", F.col("doc_id").alias("top"), "size", "content")
    total = pending.agg(F.sum(F.col("size") + ROW_BYTES).alias("b")).first().b or 0
    fan = max(1, -(-2 * total // leaf_bytes))
    pending = pending.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(0)), F.lit(fan)))
    leaves: list[DataFrame] = []
    folds: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        sizes = pending.groupBy("bucket").agg(F.sum(F.col("size") + ROW_BYTES).alias("bytes"), F.count(F.lit(1)).alias("rows"),
                                              F.min("h").alias("lo"), F.max("h").alias("hi"))
        # copies of one content are folded by as many as fit, two at least
        per = F.greatest(F.lit(2), F.floor(F.lit(leaf_bytes) * F.col("rows") / F.col("bytes")))
        over = materialize(sizes.withColumn("pieces", F.when(F.col("lo") < F.col("hi"), F.ceil(2 * F.col("bytes") / leaf_bytes))
                                            .otherwise(F.ceil(F.col("rows") / per))).filter(
            (F.col("bytes") > leaf_bytes) & (F.col("rows") > 1) & (F.col("pieces") > 1)), "exact-over")
        n_over = over.count()
        if not n_over:
            leaves.append(pending)
            break
        small = F.broadcast(over) if n_over <= BROADCAST_BUCKETS else over
        leaves.append(pending.join(small.select("bucket"), "bucket", "left_anti"))
        again = pending.join(small, "bucket")
        split = again.filter("lo < hi").withColumn(
            "bucket", F.xxhash64("bucket", F.pmod(F.xxhash64("h", F.lit(level)), "pieces"), F.lit(level)))
        pieces = again.filter("lo = hi").withColumn("piece", F.pmod(F.xxhash64("rec", F.lit(level)), "pieces"))
        folded = materialize_texts(pieces.select(*pending.columns, "piece").groupBy("bucket", "piece").applyInArrow(
            _compare(True), _CLASSES), "exact-folds")
        folds.append(folded.select("rec", "rep"))
        stay = folded.filter("rec = rep").withColumn("bucket", F.xxhash64("h", F.lit(level)))
        spill = split.select(*pending.columns).unionByName(stay.select(*pending.columns))
        pending = materialize(spill, "exact-spill")
    out = None
    for leaf in leaves:
        part = dealt_by_bytes(leaf, ["bucket"], total, TASK_BYTES).groupBy("bucket").applyInArrow(_compare(False), _CLASSES).select("rec", "rep", "n", "top")
        out = part if out is None else out.unionByName(part)
    out = materialize(out, "exact-classes")
    for fold in reversed(folds):
        gone = fold.filter("rec <> rep").select(F.col("rec").alias("from"), F.col("rep").alias("rec"))
        out = materialize(out.unionByName(gone.join(out, "rec").select(F.col("from").alias("rec"), "rep", "n", "top")), "exact-classes")
    return out


def exact_duplicates(docs: DataFrame, leaf_bytes: int = LEAF_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    found = materialize_texts(records(docs, table_bytes), "exact-records")
    named = classes(found, leaf_bytes).select("rec", "rep", F.col("n").alias("group_size"), F.col("top").alias("keep_id"))
    rows = found.select("rec", "doc_id", "digest", "best", F.col("size").alias("n_bytes"))
    return rows.join(named, "rec").select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("rec") == F.col("rep"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__exact_id"), F.col("text_sha256").alias("__exact_kept"))
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, UPPER.lower())
    keyed = docs.withColumn("__exact_sha", F.sha2(low, 256))
    same = (F.col("__exact_sha") == F.col("__exact_kept")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__exact_id"))
    return keyed.join(kept, same, "left_semi").dropDuplicates(["__exact_sha"]).drop("__exact_sha")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_bytes")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
