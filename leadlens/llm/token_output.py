"""Token-id output: documents as compressed binary blocks of ids, in ascending doc_id order.

``write`` range-partitions documents by doc_id (one shuffle of the texts), tokenises each
partition in order and cuts its id stream into blocks of ``BLOCK_IDS`` ids for the range coder of
``rangecoder``.  Blocks are reset and checksummed one by one.  The files are Parquet with one row
per block: its shard (ascending with doc_id) and number, the ids before it in its shard, its
documents' pieces (doc_id, ordinal in the shard, start in the document, length, ids of the
document in all) and the binary payload.  Spark's committer writes them to any shared store, and
a lost task is written again.

``read`` decodes blocks, each alone, to one row per document piece; ``documents_of`` sums the
pieces up to documents.  Checksums of pieces combine to the document's by xor once each is
shifted by the ids that follow it, so no document is gathered in one place; starts are sums over
shards (one row per shard) plus the place in the shard.

Defined results: a null text is the empty text (its end id alone); rows that share a doc_id are
kept one by one in text order, null doc_ids come first; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.session import scratch_path

from . import rangecoder
from .common import column, crc32_ids, crc32_shift, table, texts
from .tokenize import tokenizer, vocabulary_path

END_ID = 2
VOCABULARY_SIZE = 50_257

_BLOCK = ("shard int, block int, first_id long, n_ids int, doc_id array<long>, doc_no array<long>, "
          "piece_start array<long>, piece_length array<long>, doc_tokens array<long>, payload binary")
_PIECE = ("shard int, doc_no long, doc_id long, doc_start long, piece_start long, length long, "
          "doc_tokens long, crc32 long, crc32_in_doc long")
_LONGS = pa.list_(pa.int64())


class _Shard:
    """Cuts one partition's id stream into blocks."""

    def __init__(self, shard: int, block_ids: int, vocabulary_size: int):
        self.shard, self.block_ids, self.vocabulary_size = shard, block_ids, vocabulary_size
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple] = []  # (doc_id, doc_no, start, length, tokens)
        self.held = self.first = self.block = self.doc_no = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < len(ids):
            take = min(len(ids) - start, self.block_ids - self.held)
            self.ids.append(ids[start:start + take])
            self.pieces.append((doc_id, self.doc_no, start, take, len(ids)))
            self.held += take
            start += take
            if self.held == self.block_ids:
                yield self.flush()
        self.doc_no += 1

    def flush(self) -> pa.RecordBatch:
        payload = rangecoder.encode(np.concatenate(self.ids), self.vocabulary_size)
        lists = [pa.array([list(x)], _LONGS) for x in zip(*self.pieces)]
        names = [f.split(" ")[0] for f in _BLOCK.split(", ")]
        out = pa.RecordBatch.from_arrays(
            [pa.array([self.shard], pa.int32()), pa.array([self.block], pa.int32()), pa.array([self.first], pa.int64()),
             pa.array([self.held], pa.int32()), *lists, pa.array([payload], pa.binary())], names=names)
        self.first += self.held
        self.block += 1
        self.ids, self.pieces, self.held = [], [], 0
        return out


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID,
          vocabulary_size: int = VOCABULARY_SIZE, block_ids: int = rangecoder.BLOCK_IDS) -> None:
    """Write the documents' ids to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary, leading_blank=True)
        shard = _Shard(TaskContext.get().partitionId(), block_ids, vocabulary_size)
        for batch in batches:
            doc_ids = column(batch, "doc_id").to_pylist()
            for lo, ids, ends in tok.batches(texts(batch), end_id):
                for k in range(len(ends) - 1):
                    yield from shard.add(doc_ids[lo + k], ids[ends[k]:ends[k + 1]])
        if shard.held:
            yield shard.flush()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, _BLOCK).write.mode("overwrite").parquet(path))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document piece of the files' blocks, decoded."""
    names = [f.split(" ")[0] for f in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = rangecoder.decode(b["payload"])
                if len(ids) != b["n_ids"]:
                    raise ValueError("a block does not hold the ids that its row counts")
                at = np.cumsum([0, *b["piece_length"]])
                rows, parts = [], []
                for k, (doc, no, start, length, tokens) in enumerate(zip(
                        b["doc_id"], b["doc_no"], b["piece_start"], b["piece_length"], b["doc_tokens"])):
                    part = ids[at[k]:at[k + 1]]
                    crc = crc32_ids(part)
                    rows.append((b["shard"], no, doc, b["first_id"] + int(at[k]) - start, start, length, tokens, crc,
                                 crc32_shift(crc, 4 * (tokens - start - length))))
                    parts.append(part)
                columns = [pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(zip(*rows))]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return spark.read.parquet(path).mapInArrow(run, _PIECE + ", ids array<int>" * with_ids)


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32."""
    shards = spark.read.parquet(path).groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    docs = read(spark, path).groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("doc_start").alias("doc_start"),
        F.sum("length").alias("n_tokens"), F.bit_xor("crc32_in_doc").alias("ids_crc32"))
    return docs.join(shards, "shard").select(
        "doc_id", (F.col("shard_start") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-output")
    write(table(spark, sf_dir, "documents"), path, vocabulary_path("byte_bpe_50k.json"))
    return documents_of(spark, path)
