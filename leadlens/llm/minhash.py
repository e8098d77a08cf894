"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct word shingles.  Documents with equal sets form a class; only
class representatives (the smallest doc_id) go on.

Signature and index.  A signature has ``CHUNKS`` chunks of 4 symbols, each 14 bits of a minimum
over the set.  By the pigeonhole principle two signatures that differ in at most ``2 * CHUNKS - 1``
symbols differ in at most one symbol of some chunk, so a key per chunk and left-out symbol (48
keys) puts every such pair into a common bucket.  A pair at the contract's similarity of 0.85
exceeds that distance with a probability near 1e-9, at 0.8 near 1e-6.

Links without all pairs.  The buckets of one smallest document (the leader) form a group.  Every
document is first compared with its leaders, at most 48, on the full sets:
``100 * intersection >= similarity * union``.  Then the documents that a leader is not linked with
are compared with the others of its group on the full sets, block against block, as matrix
products inside a task.  A cell of that grid returns at most one link per component that it
joins, never its pairs; documents linked with the leader are not compared with each other, since
they are connected already.  So no pair of a bucket is left out, and the components are exact.

Defined results: a null or wordless text has an empty set and is linked with nothing (its
component is its own doc_id); repeated rows are copies of each other; rows with a null doc_id have
a null component and are kept; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.session import materialize

from .common import arrow_rows, column, materialize_texts, mix64, slices, table, texts
from .components import components
from .shingles import distinct, shingles

SHINGLE_WORDS = 5
CHUNKS = 12
_LANES, _BITS = 4, 15
_LANE = (1 << _BITS) - 1
_CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]

#: Rows of an Arrow batch that carries two whole sets.
PAIR_BATCH = 500
#: A block of a group's grid: about so many documents, or shingles of theirs.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 500_000


def _factors() -> np.ndarray:
    seeds = np.arange(1, CHUNKS * _LANES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix64(seeds) | np.uint64(1)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Chunks (longs) of the sets that start at ``starts``, none of them empty."""
    out = []
    factors = _factors()
    for c in range(CHUNKS):
        chunk = np.zeros(len(starts), np.int64)
        for lane in range(_LANES):
            low = np.minimum.reduceat(hashes * factors[c * _LANES + lane], starts)
            symbol = (mix64(low) >> np.uint64(64 - _BITS + 1)).astype(np.int64)
            chunk |= symbol << (_BITS * lane)
        out.append(chunk)
    return out


def sketches(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, the set's 128-bit name (set_a, set_b) and its signature
    chunks; all of these but n_shingles are null for an empty set."""
    names = ["doc_id", "n_shingles", "set_a", "set_b", *_CHUNK_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = texts(batch), column(batch, "doc_id").cast(pa.int64())
            for lo, hi in slices(text):
                hashes, offsets = distinct(*shingles(text.slice(lo, hi - lo), shingle_words))
                counts = np.diff(offsets)
                some = counts > 0
                starts = offsets[:-1][some]
                values = []
                if some.any():
                    values = [np.add.reduceat(mix64(hashes ^ np.uint64(k)), starts).astype(np.int64) for k in (1, 2)]
                    values += signatures(hashes, starts)
                else:
                    values = [np.zeros(0, np.int64)] * (2 + CHUNKS)
                columns = []
                for v in values:
                    full = np.zeros(hi - lo, np.int64)
                    full[some] = v
                    columns.append(pa.array(full, pa.int64(), mask=~some))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(counts), *columns], names=names)

    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _keys() -> F.Column:
    """The 48 keys of a signature: each chunk with one symbol left out."""
    return F.array(*[
        F.xxhash64(F.lit(c * _LANES + lane), F.col(name).bitwiseAND(F.lit(~(_LANE << (_BITS * lane)))))
        for c, name in enumerate(_CHUNK_NAMES) for lane in range(_LANES)])


def _sizes_allow(n, m, similarity: int) -> F.Column:
    """Whether sets of these sizes can be similar enough (an exact bound)."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * similarity


def _sets(docs: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles): the full sets of some documents, as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = texts(batch), column(batch, "doc_id").cast(pa.int64())
            for lo, hi in slices(text):
                hashes, offsets = distinct(*shingles(text.slice(lo, hi - lo), shingle_words))
                blobs = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(blobs, pa.binary())],
                                                 names=["node", "shingles"])

    # the ids grow with the input: the smaller side is hashed by partition, never broadcast
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        nodes.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    return chosen.mapInArrow(run, "node long, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = column(batch, "sa"), column(batch, "sb")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(xs[i].as_buffer(), np.uint64)
                y = np.frombuffer(ys[i].as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs: a merge
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * common >= similarity * (len(both) - common)
            out = batch.select(["a", "b"]).filter(pa.array(keep))
            if out.num_rows:
                yield out

    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of groups (leader, node, n, near) in blocks of their group: one row per block with its
    nodes' sets, and the number of blocks of far and of near nodes.

    A group's nodes fall into blocks of about ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES`` shingles,
    those linked with the leader (near, the leader itself too) behind the others; groups without
    others are left out."""
    def blocks(near):
        size = F.sum(F.when(F.col("near") == near, 1).otherwise(0))
        sum_n = F.sum(F.when(F.col("near") == near, F.col("n")).otherwise(0))
        return F.ceil(F.greatest(size / BLOCK_NODES, sum_n / BLOCK_SHINGLES)).cast("int")

    mixed = groups.groupBy("leader").agg(blocks(True).alias("major"), blocks(False).alias("minor")).filter("minor > 0")
    rows = groups.join(materialize(mixed, "mixed"), "leader")  # written: a large group can be split in the join
    share = F.xxhash64("node")
    block = F.when(F.col("near"), F.col("minor") + F.pmod(share, F.col("major"))).otherwise(
        F.pmod(share, F.col("minor"))).cast("int")
    rows = rows.select("leader", "major", "minor", block.alias("block"), "node",
                       F.when(F.col("near"), F.col("leader")).otherwise(F.col("node")).alias("component")).join(sets, "node")

    def pack(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order = np.argsort(np.asarray(part["node"]), kind="stable")
        blobs = [part["shingles"][int(i)].as_buffer() for i in order]
        return pa.table({c: part[c].slice(0, 1) for c in ("leader", "major", "minor", "block")} | {
            "node": pa.array([np.asarray(part["node"])[order].tobytes()], pa.binary()),
            "component": pa.array([np.asarray(part["component"])[order].tobytes()], pa.binary()),
            "size": pa.array([np.array([x.size // 8 for x in blobs], np.int64).tobytes()], pa.binary()),
            "shingles": pa.array([b"".join(blobs)], pa.binary())})

    schema = "leader long, major int, minor int, block int, node binary, component binary, size binary, shingles binary"
    return rows.groupBy("leader", "block").applyInArrow(pack, schema)


def _cells(blocks: DataFrame) -> DataFrame:
    """Block rows dealt to the cells of their group's grid: a cell holds two blocks (``bi <= bj``);
    cells of two near blocks are left out."""
    near = F.col("block") >= F.col("minor")
    partner = F.when(near, F.sequence(F.lit(0), F.col("minor") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("minor") + F.col("major") - 1))
    rows = blocks.withColumn("other", F.explode(partner))
    return rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))


def cell_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray,
               similarity: int) -> list[tuple[int, int]]:
    """Links (row, row) between components, from rows ``left`` to rows ``right``: a spanning forest of
    them.  Intersections of all pairs are a product of 0/1 matrices over the shingles that occur
    in more than one set, some columns at a time."""
    counts = np.array([len(s) for s in sets])
    values, column_of = np.unique(np.concatenate(sets), return_inverse=True)
    row_of = np.repeat(np.arange(len(sets)), counts)
    shared = np.bincount(column_of, minlength=len(values)) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column_of]
    row_of, column_of = row_of[keep], rank[column_of[keep]]
    order = np.argsort(column_of, kind="stable")
    row_of, column_of = row_of[order], column_of[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(column_of, (lo, lo + 1024))
        ones = np.zeros((len(sets), 1024), np.float32)
        ones[row_of[a:b], column_of[a:b] - lo] = 1
        common += ones[left] @ ones[right].T  # sums under 2**24: exact
    union = counts[left][:, None] + counts[right][None] - common
    kinds, kind = np.unique(component, return_inverse=True)
    linked = (100 * common >= similarity * union) & (kind[left][:, None] != kind[right][None])
    x, y = np.nonzero(linked)
    x, y = left[x], right[y]
    _, first = np.unique(np.minimum(kind[x], kind[y]) * len(kinds) + np.maximum(kind[x], kind[y]), return_index=True)
    parent = list(range(len(kinds)))
    out = []
    for i, j in zip(x[first].tolist(), y[first].tolist()):
        a, b = int(kind[i]), int(kind[j])
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _across(groups: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of nodes that their group's leader is not linked with (leader, node, n, near)."""

    def run(cell: pa.Table) -> pa.Table:
        parts = sorted(cell.to_pylist(), key=lambda r: r["block"])  # one or two blocks
        node, component, sizes, block = (np.concatenate(x) for x in zip(*[
            (np.frombuffer(r["node"], np.int64), np.frombuffer(r["component"], np.int64), np.frombuffer(r["size"], np.int64),
             np.full(len(r["node"]) // 8, r["block"])) for r in parts]))
        values = np.frombuffer(b"".join(r["shingles"] for r in parts), np.uint64)
        ends = np.cumsum(sizes)
        shingle_sets = [values[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        bi, bj = parts[0]["bi"], parts[0]["bj"]
        found = cell_links(shingle_sets, np.flatnonzero(block == bi), np.flatnonzero(block == bj), component, similarity)
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()),
                         "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    rows = _cells(materialize(_blocks(groups, sets), "blocks"))
    return rows.groupBy("leader", "bi", "bj").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, similarity: int, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Links (a, b) between the representatives ``nodes`` (node, n, chunks): not every pair, but as
    many as connect all that are similar."""
    spark = docs.sparkSession
    keyed = nodes.select("node", "n", F.explode(_keys()).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("other"))
    buckets = buckets.filter("first.node <> other").select(
        "key", F.col("first.node").alias("leader"), F.col("first.n").alias("leader_n"))
    # all buckets of one leader form a group; two nodes of a bucket are in its leader's group
    groups = materialize(keyed.join(buckets, "key").select("leader", "leader_n", "node", "n").distinct(), "groups")
    sets = materialize_texts(_sets(docs, groups, shingle_words), "sets")

    star = groups.filter("node <> leader").filter(_sizes_allow(F.col("n"), F.col("leader_n"), similarity))
    with arrow_rows(spark, PAIR_BATCH):
        near = materialize(_confirm(star.select(F.col("leader").alias("a"), F.col("node").alias("b")), sets, similarity), "links")
    flag = near.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.lit(True).alias("near"))
    flagged = groups.join(flag, ["leader", "node"], "left").select(
        "leader", "node", "n", (F.coalesce("near", F.lit(False)) | (F.col("node") == F.col("leader"))).alias("near"))
    return near.unionByName(materialize(_across(flagged, sets, similarity), "links"))


def near_duplicates(docs: DataFrame, similarity: int = 80, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links,
    itself included) and kept (it is that document)."""
    sketch = materialize_texts(sketches(docs, shingle_words), "sketches")
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in _CHUNK_NAMES])
    classes = materialize(classes, "classes")
    labels = components(links(docs, classes.select("node", "n", *_CHUNK_NAMES), similarity, shingle_words))
    named = classes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "node").join(labels, "node", "left")
    named = named.select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"))
    out = some.join(named, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketch.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), similarity=85)
