"""Exact substring dedup: bytes covered by a 200-byte string that starts more than once.

Suffixes are sorted only at anchors (see ``suffixes``), one in some 85 places, and only anchors whose
leading gram occurs at least twice are exchanged; all others cannot share 200 bytes.

1. A scan writes, per document, its anchors' gram hashes with its length and digest.  Gram counts
   over all documents tell the documents and anchors that may repeat.
2. Texts of those documents are joined once.  Every task turns its anchors' hulls into sorted,
   distinct, front-coded runs of at most ``RUN_BYTES``, one per range; a range is a share of the
   leading grams' hashes, so suffixes with a common gram meet and ranges are even.
3. A task per range merges its runs with a loser tree that compares only past known common
   prefixes; shared prefixes in merged order tell which windows repeat.  Equal hulls are one entry,
   however many copies there are.
4. Repeated windows go back to the places of their hulls by the hull's 128-bit name, and each
   document's covered bytes are removed.

A gram with more than ``HOT`` occurrences is not merged in one task: its hulls, distinct within each
task, are counted by name, and their windows by 128-bit mark, in plain aggregations that spread any
single gram over all tasks; the result is the same.  The join that finds repeated grams is salted
for grams with more than one in ``HEAVY`` of all occurrences, of which there are fewer than ``HEAVY``.

A stretch of short period (one byte, or a few, over and over) has an anchor in every period; its
equal hulls are one entry with the distance to the last, so its work and memory grow with its bytes.

Defined results: a null text is the empty text; repeated rows repeat each other and are returned
one by one; a null doc_id stays null; texts under 200 bytes lose nothing; a text of one repeated
byte or short period, of any length, is covered by its own repeats and goes whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import materialize, shuffle_partitions

from . import suffixes
from .common import column, dealt_by_bytes, materialize_texts, mix64, slices, table, texts, utf8
from .suffixes import WINDOW, make_key, name_of

CHUNK = 1 << 20  # bytes whose anchors are found at a time
RUN_BYTES = 24 << 20
RANGE_ENTRIES = 50_000
HOT = 20_000
HEAVY = 1000
TASK_BYTES = 128 << 20

_SCAN = "k long, h long, doc_id long, n_bytes long, sha256 string, grams array<long>"
_PLACED = ("no long, doc_id long, body binary, names array<binary>, places array<int>, runs array<int>, "
           "range int, run binary, name binary, key binary, `right` int, several boolean")


def anchors_of(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first text, end, anchors without those of a period but the first) for some texts at a time;
    a long text in overlapping chunks."""
    lo = 0
    n = len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * CHUNK:
            starts = offsets[lo:hi + 1] - a
            yield lo, hi, suffixes.fold_periods(raw[a:b], starts, suffixes.anchors(raw[a:b], starts))
        else:  # one long text
            parts = []
            for c in range(a, b, CHUNK):
                end = min(b, c + CHUNK + WINDOW - 1)
                starts = np.array([0, end - c])
                r, g, p, first, last, run = suffixes.fold_periods(raw[c:end], starts, suffixes.anchors(raw[c:end], starts))
                parts.append((r, g, p + c - a, first + c - a, last + c - a, run))
            yield lo, hi, tuple(np.concatenate(x) for x in zip(*parts))
        lo = hi


def _scan(docs: DataFrame) -> DataFrame:
    """Anchors' grams per document; a gram that a period repeats is listed once more behind them."""
    names = [f.split(" ")[0] for f in _SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts(batch)
            for lo, hi in slices(text, CHUNK):
                raw, offsets = utf8(text.slice(lo, hi - lo))
                grams, counts = [], np.zeros(hi - lo, np.int64)
                for first, _, (row, g, _, _, _, run) in anchors_of(raw, offsets):
                    if run.any():
                        again = np.flatnonzero(run)
                        row, g = np.concatenate((row, row[again])), np.concatenate((g, g[again]))
                        order = np.argsort(row, kind="stable")
                        row, g = row[order], g[order]
                    grams.append(g)
                    counts += np.bincount(row + first, minlength=hi - lo)
                flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
                digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c).slice(lo, hi - lo) for c in ("k", "h", "doc_id")), pa.array(np.diff(offsets)),
                     pa.array(digests, pa.string()), lists], names=names)

    return docs.mapInArrow(run, _SCAN)


def _place(chosen: DataFrame, n_ranges: int) -> DataFrame:
    """Runs by range, hot hulls, and the documents (k, h, doc_id, text, at: their anchors' numbers,
    hot: which of them are hot) with the names and places of their hulls."""
    names = [f.split(" ")[0].strip("`") for f in _PLACED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()),
             pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.bool_()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: dict[int, dict[tuple[bytes, int], bool]] = {}
        hot_held: dict[tuple[bytes, int], bool] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            order = sorted(held)
            if order:
                yield rows(range=order, run=[suffixes.encode_run(suffixes.sort_run(held[r])) for r in order])
            hulls = list(hot_held.items())
            for at in range(0, len(hulls), 2000):
                some = hulls[at:at + 2000]
                yield rows(name=[name_of(*hull) for hull, _ in some], key=[k for (k, _), _ in some],
                           right=[r for (_, r), _ in some], several=[many for _, many in some])
            held.clear()
            hot_held.clear()
            size = 0

        for batch in batches:
            text, at_lists, hot_lists = texts(batch), column(batch, "at").to_pylist(), column(batch, "hot").to_pylist()
            ids = column(batch, "doc_id").to_pylist()
            for lo, hi in slices(text, CHUNK):
                raw, offsets = utf8(text.slice(lo, hi - lo))
                out = []
                for first, end, (row, g, p, a, b, period) in anchors_of(raw, offsets):
                    begin = np.searchsorted(row, np.arange(end - first + 1))
                    for i in range(first, end):
                        body = raw[offsets[i]:offsets[i + 1]].tobytes()
                        chosen_at = [n for n in at_lists[lo + i] if n < begin[i - first + 1] - begin[i - first]]
                        at = np.array(chosen_at, np.int64) + begin[i - first]
                        # hashed anew: anchors are chosen for their small gram hashes
                        ranges = (mix64(~g[at]) >> np.uint64(33)).astype(np.int64) * n_ranges >> 31
                        hot = set(hot_lists[lo + i] or ())
                        hulls = []
                        for n, q, x, y, r, run_length in zip(chosen_at, p[at].tolist(), a[at].tolist(), b[at].tolist(),
                                                             ranges.tolist(), period[at].tolist()):
                            key, right = make_key(body, q, x, y)
                            hulls.append(name_of(key, right))
                            entries = hot_held if n in hot else held.setdefault(r, {})
                            there = (key, right) in entries
                            entries[key, right] = there or run_length > 0
                            size += 0 if there else len(key) + 250
                        out.append((number, ids[lo + i], body, hulls, p[at].tolist(), period[at].tolist()))
                        number += 1
                yield rows(**dict(zip(("no", "doc_id", "body", "names", "places", "runs"), zip(*out))))
                if size >= RUN_BYTES:
                    yield from flush()
        yield from flush()

    return chosen.select("doc_id", "text", "at", "hot").mapInArrow(run, _PLACED)


def _merged(runs: DataFrame) -> DataFrame:
    """(name, first, last): repeated windows of hulls, per range."""

    def run(part: pa.Table) -> pa.Table:
        blobs = part.column("run").to_pylist()
        found = list(suffixes.repeats_of(suffixes.merge_runs(blobs)))
        return pa.table([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()),
                         pa.array([f[2] for f in found], pa.int32())], names=["name", "first", "last"])

    return runs.groupBy("range").applyInArrow(run, "name binary, first int, last int")


def _hot(hulls: DataFrame) -> DataFrame:
    """(name, first, last) for hulls (name, key, right, several) of hot grams."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(column(batch, "key").to_pylist(), column(batch, "right").to_pylist()))
            for lo in range(0, len(keys), 2000):
                owner, distance, a, b = suffixes.window_marks(keys[lo:lo + 2000])
                pick = pa.array(owner + lo)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "name").take(pick), pa.array(distance, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                     column(batch, "many").take(pick)], names=["name", "distance", "a", "b", "many"])

    one = hulls.groupBy("name").agg(F.first("key").alias("key"), F.first("right").alias("right"),
                                    ((F.count(F.lit(1)) > 1) | F.max("several")).alias("many"))
    marks = materialize(materialize(one, "hot-hulls").mapInArrow(windows, "name binary, distance int, a long, b long, many boolean"), "hot-windows")
    twice = marks.groupBy("distance", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("any")).filter("n > 1 OR any")
    # written, so that a window of very many hulls can be split in the join
    twice = materialize(twice.select("distance", "a", "b"), "hot-repeats")
    return marks.join(twice, ["distance", "a", "b"]).select(
        "name", F.col("distance").alias("first"), F.col("distance").alias("last"))


def _repeated_grams(grams: DataFrame) -> DataFrame:
    """The rows of ``grams`` (gram, ...) whose gram occurs at least twice, with its count n."""
    counts = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "grams")
    share = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    parts = F.ceil(F.col("n") / share).cast("int")
    heavy = counts.filter(F.col("n") > share).select("gram", parts.alias("parts"))  # fewer than HEAVY rows
    dealt = grams.join(F.broadcast(heavy), "gram", "left").withColumn(
        "salt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("k", "h", "at"), "parts")).cast("int")).drop("parts")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(salted, ["gram", "salt"]).drop("salt")


def _kept(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans from documents with the repeated
    windows' stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body, starts, ends in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "body", "starts", "ends"))):
                spans: list[list[int]] = []
                for a, b in sorted(zip(starts or (), ends or ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(body[at:a])
                    at = b
                digest.update(body[at:])
                out.append((doc, len(body), sum(b - a for a, b in spans), len(spans), digest.hexdigest(),
                            [{"start": a, "end": b} for a, b in spans]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.select("doc_id", "body", "starts", "ends").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"), "doc_id", "text")
    scan = materialize_texts(_scan(docs), "anchors")

    grams = scan.select("k", "h", F.posexplode("grams").alias("at", "gram"))
    maybe = _repeated_grams(grams).groupBy("k", "h").agg(
        F.sort_array(F.collect_set("at")).alias("at"), F.collect_set(F.when(F.col("n") > hot, F.col("at"))).alias("hot"))
    maybe = materialize(maybe, "candidates")
    entries = maybe.agg(F.sum(F.size("at"))).first()[0] or 0
    n_ranges = max(1, min(shuffle_partitions(spark), -(-entries // 1000)), -(-entries // RANGE_ENTRIES))

    n_bytes = scan.agg(F.sum("n_bytes")).first()[0] or 0
    chosen = dealt_by_bytes(docs, ["k", "h"], n_bytes, TASK_BYTES).join(maybe.hint("shuffle_hash"), ["k", "h"])
    placed = materialize_texts(_place(chosen, n_ranges), "suffixes")
    found = _merged(placed.filter("run IS NOT NULL").select("range", "run"))
    if maybe.filter(F.size("hot") > 0).limit(1).count():
        found = found.unionByName(_hot(placed.filter("key IS NOT NULL").select("name", "key", "right", "several")))
    found = materialize(found, "repeats")

    bodies = placed.filter("no IS NOT NULL")
    hulls = bodies.select("no", F.explode(F.arrays_zip("names", "places", "runs")).alias("x")).select(
        "no", F.col("x.names").alias("name"), F.col("x.places").alias("p"), F.col("x.runs").alias("run"))
    stretches = hulls.join(found, "name").groupBy("no").agg(
        F.collect_list((F.col("p") - F.col("last")).alias("a")).alias("starts"),
        F.collect_list((F.col("p") + F.col("run") - F.col("first") + WINDOW).alias("b")).alias("ends"))
    touched = _kept(bodies.select("no", "doc_id", "body").join(stretches, "no", "left"))
    rest = scan.join(maybe.select("k", "h"), ["k", "h"], "left_anti").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    return touched.unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
