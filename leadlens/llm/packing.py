"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Each document becomes its ids plus an end id.  Documents longer than a window are first cut
into full windows; the rest of each document is placed, longest first, into the open window
that it fills most tightly, found with a segment tree indexed by remaining capacity.  Packing
happens where the documents lie: a group is the documents of one input partition, up to
``GROUP_IDS`` ids, so nothing is shuffled, memory is bounded by the group and a lost task is
repeated alone.  A group leaves about one window partly filled.

A sequence is padded to the window's length, except one whose ids are a power of two in number, which
stays as it is: ``padded_length`` says so for each piece's sequence.  Every group may leave one
window partly filled, so very many tiny partitions pad more: coalesce them first.

Defined results: a null text is the empty text (its end id alone); a null doc_id stays null;
repeated rows are packed once each; an empty table gives no pieces; columns other than
``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, crc32_ids, table, texts
from .tokenize import tokenizer, vocabulary_path

WINDOW = 4096
END_ID = 2
GROUP_IDS = 8_000_000

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, `offset` long, padded_length long")


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over the capacities 0..window says
    which of them have an open window."""

    def __init__(self, window: int):
        self.window = window
        self.half = 1 << (window + 1).bit_length()
        self.tree = bytearray(2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, sequence: int, capacity: int) -> None:
        if capacity == 0:
            return
        self.open[capacity].append(sequence)
        i = self.half + capacity
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open window that holds ``length``: (sequence, capacity), removed."""
        tree, i = self.tree, self.half + length
        while not tree[i]:
            while i & 1:  # a right child: what lies to the right is under the parent's sibling
                i >>= 1
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf
                return None
        while i < self.half:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.half
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while i and not (tree[2 * i] or tree[2 * i + 1] if i < self.half else 0):
                tree[i] = 0
                i >>= 1
        return sequence, capacity


def best_fit_decreasing(lengths: np.ndarray, window: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each length (at most ``window``), and the next unused sequence.
    Ties go to the earlier length."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, new = OpenWindows(window), first
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = windows.take(n)
        if found is None:
            found = new, window
            new += 1
        at, capacity = found
        sequence[i], offset[i] = at, window - capacity
        windows.add(at, capacity - n)
    return sequence, offset, new


def pack_group(lengths: np.ndarray, window: int, first: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents of these lengths: (document, start, length, sequence, offset)."""
    full = lengths // window
    rest = lengths - full * window
    count = full + (rest > 0)
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = piece * window
    length = np.minimum(window, lengths[doc] - start)
    whole = length == window
    sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    sequence[whole] = first + np.arange(int(whole.sum()))
    sequence[~whole], offset[~whole], new = best_fit_decreasing(length[~whole], window, first + int(whole.sum()))
    return doc, start, length, sequence, offset, new


def padded_lengths(sequence: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """For each piece the padded length of its sequence."""
    if not len(sequence):
        return np.zeros(0, np.int64)
    used = np.bincount(sequence - sequence.min(), length).astype(np.int64)
    return np.where(used & (used - 1) == 0, used, window)[sequence - sequence.min()]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID,
         group_ids: int = GROUP_IDS, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, start in it, length, crc32 of its ids, the document's
    ids in all, the sequence, the offset there (gapless from 0) and the sequence's length with
    padding.  ``with_ids`` adds the ids.
    ``sequence_id`` is unique, not dense: the task's partition in the upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary, leading_blank=False)
        new = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush(new: int) -> tuple[pa.RecordBatch, int]:
            lengths = np.concatenate([np.diff(ends) for _, _, ends in held])
            ids = np.concatenate([i for _, i, _ in held])
            doc_ids = pa.concat_arrays([d for d, _, _ in held])
            doc, start, length, sequence, offset, new = pack_group(lengths, window, new)
            lo = (np.cumsum(lengths) - lengths)[doc] + start
            parts = [ids[a:b] for a, b in zip(lo.tolist(), (lo + length).tolist())]
            columns = [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length),
                       pa.array([crc32_ids(p) for p in parts], pa.int64()), pa.array(lengths[doc]),
                       pa.array(sequence), pa.array(offset), pa.array(padded_lengths(sequence, length, window))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names), new

        size = 0
        for batch in batches:
            doc_ids = column(batch, "doc_id").cast(pa.int64())
            for lo, ids, ends in tok.batches(texts(batch), end_id):
                held.append((doc_ids.slice(lo, len(ends) - 1), ids, ends))
                size += len(ids)
                if size >= group_ids:
                    out, new = flush(new)
                    yield out
                    held.clear()
                    size = 0
        if held:
            yield flush(new)[0]

    schema = _SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
