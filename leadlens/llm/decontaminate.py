"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``PASSAGE`` words.  Words are runs of letters,
digits and non-ASCII characters, with A-Z lower-cased; the vocabulary is that of the passages.

1. ``terms`` turns every whole document into vocabulary numbers, written once.
2. Passage frequencies over all documents give the idf of each term, positive however common it is.
3. A distributed randomised SVD of the passages' TF-IDF rows: partitions add up
   ``A'(A G)`` for a random G, its orthonormal basis Q is formed, and the sums ``(A Q)'(A Q)`` give
   the singular vectors, of at most ``RANK``.
4. Each document slides windows of ``WINDOW`` blocks of ``BLOCK`` words, one block at a time;
   windows and passages meet by cosine in the latent space (one matrix product per batch), and
   those at ``COSINE`` or more are candidates.
5. Candidates by words, which need no cosine: a run of ``span`` = length / ``VERBATIM`` words that has
   ``VERBATIM`` of a passage in order holds all but a fifth of its word places, hence at least ``SEEDS``
   (fewer on the shortest passages) of that fifth and ``SEEDS`` more.  The rarest places are taken,
   and wherever enough of them stand within a span, the words around are compared.  No copy is lost, verbatim
   or with up to a fifth of its words changed, whatever stands beside it.
6. A candidate is confirmed on the words around its window: the longest common subsequence with
   the passage covers ``VERBATIM`` of the passage, or, for a paraphrase, ``PARAPHRASE`` of it while
   the answer also occurs (``ANSWER`` of the words of the item's ``answer``; without such a column the
   passage's last fifth stands for it).

The benchmark is read in blocks of ``ITEM_BLOCK`` items, and ``PASS_BLOCKS`` blocks share one vocabulary
and one reading of the documents, so what goes to every task is bounded (the vocabulary of a pass,
then the vectors of one block); more items mean more passes over the documents, and every block one
over their written numbers.

Defined results: items with fewer than ``MIN_WORDS`` words (null and empty texts included) match
nothing; null or empty documents match nothing; repeated items are told apart only by item_id;
repeated documents each match; rows without doc_id or item_id are judged too, the id stays null;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .common import column, materialize_texts, ranges, slices, table, texts
from .shingles import SIGNS, words

PASSAGE = 64
BLOCK = 16
WINDOW = 5  # blocks: a passage fits wherever it starts in its first block (summed as 2 + 2 + 1 in ``search``)
RANK = 128
OVERSAMPLE = 16
COSINE = 0.45
VERBATIM, PARAPHRASE, ANSWER = 0.8, 0.6, 0.6
MIN_WORDS = 5
ITEM_BLOCK = 1000
PASS_BLOCKS = 20  # blocks that share one reading of the documents
SEEDS = 3  # rare words of a passage that must meet; any number loses nothing, more give fewer candidates
SEED_HITS = 1_000_000  # occurrences of rare words that are sorted together
SUM_ROWS = 64  # rows of a matrix sum that travel together


def hashes(items: list[str]) -> list[np.ndarray]:
    word, at = words(pa.array(items, pa.string()), SIGNS)
    return [word[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Passages:
    """The passages of one block of items: (item_id, words), their vocabulary and answers."""

    def __init__(self, items: list[tuple[int | None, str, str | None]]):
        self.item: list[int | None] = []
        found: list[np.ndarray] = []
        answers: list[np.ndarray] = []
        whole, given = hashes([t for _, t, _ in items]), hashes([a or "" for _, _, a in items])
        for (item, _, answer), ids, reply in zip(items, whole, given):
            if len(ids) < MIN_WORDS:
                continue
            parts = -(-len(ids) // PASSAGE)
            for part in np.array_split(ids, parts):
                self.item.append(item)
                found.append(part)
                answers.append(reply if answer and len(reply) else part[-max(3, len(part) // 5):])
        self.vocabulary = np.unique(np.concatenate(found + answers)) if found else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, p) for p in found]
        self.answers = [np.searchsorted(self.vocabulary, p) for p in answers]


def terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms): the document's words as little-endian int32 numbers in the vocabulary, -1
    for others."""
    # a first look by the hash's low bits spares most words the search
    seen = np.zeros(1 << 20, bool)
    seen[(vocabulary & np.uint64(len(seen) - 1)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = texts(batch), column(batch, "doc_id").cast(pa.int64())
            for lo, hi in slices(text):
                word, at = words(text.slice(lo, hi - lo), SIGNS)
                out = np.full(len(word), -1, np.int32)
                maybe = np.flatnonzero(seen[(word & np.uint64(len(seen) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(vocabulary, word[maybe]), len(vocabulary) - 1)
                out[maybe] = np.where(vocabulary[place] == word[maybe], place, -1)
                blobs = [out[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(blobs, pa.binary())], names=["doc_id", "terms"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, terms binary")


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, terms, first term of each row and the end) for some rows at a time."""
    blobs = column(batch, "terms")
    raw = [b.as_buffer() for b in blobs]
    sizes = np.array([b.size // 4 for b in raw], np.int64)
    lo = 0
    while lo < len(raw):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), 100_000, side="right")))
        hi = min(hi, len(raw))
        flat = np.frombuffer(b"".join(raw[lo:hi]), np.int32)
        yield lo, flat, np.concatenate(([0], np.cumsum(sizes[lo:hi])))
        lo = hi


def passage_frequencies(found: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many runs of ``PASSAGE`` words of all documents each term occurs, and how many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for _, flat, at in _rows_of(batch):
                sizes = np.diff(at)
                runs = -(-sizes // PASSAGE)
                first = np.cumsum(runs) - runs
                inside = np.arange(len(flat)) - np.repeat(at[:-1], sizes)
                grid = np.full((int(runs.sum()), PASSAGE), -1, np.int32)
                grid[np.repeat(first, sizes) + inside // PASSAGE, inside % PASSAGE] = flat
                grid.sort(axis=1)
                new = np.ones(grid.shape, bool)
                new[:, 1:] = grid[:, 1:] != grid[:, :-1]
                once = grid[new & (grid >= 0)]
                counts += np.bincount(once, minlength=n_terms)
                total += len(grid)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], names=["term", "n"])

    sums = found.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term
    out = np.zeros(n_terms, np.int64)
    total = 0
    for r in sums:
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def latent_space(spark: SparkSession, passages: list[np.ndarray], idf: np.ndarray, rank: int = RANK, seed: int = 3) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' TF-IDF rows, by a randomised SVD
    whose sums over rows are Spark's."""
    n_terms = len(idf)
    width = min(rank + OVERSAMPLE, len(passages), n_terms)
    rows = spark.createDataFrame([(p.astype(np.int32).tolist(),) for p in passages], "terms array<int>").repartition(
        max(1, min(len(passages) // 200, 64)))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        lists = column(batch, "terms")
        a = np.zeros((batch.num_rows, n_terms))
        n = np.diff(np.asarray(lists.offsets))
        np.add.at(a, (np.repeat(np.arange(batch.num_rows), n), np.asarray(lists.flatten())), 1)
        a *= idf
        return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)

    def sums(f, height: int) -> np.ndarray:
        """Sum over partitions of f(A), height x width, in blocks of ``SUM_ROWS`` rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((height, width))
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    total += f(matrix(batch.slice(lo, 256)))
            starts = range(0, height, SUM_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(starts), pa.int64()), pa.array([total[lo:lo + SUM_ROWS].tobytes() for lo in starts], pa.binary())],
                names=["row", "v"])

        def add(part: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v, float) for v in part.column("v").to_pylist())  # one block of each partition
            return pa.table({"row": part["row"].slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((height, width))
        for r in rows.mapInArrow(run, "row long, v binary").groupBy("row").applyInArrow(add, "row long, v binary").collect():
            block = np.frombuffer(r.v, float).reshape(-1, width)
            out[r.row:r.row + len(block)] = block
        return out

    g = np.random.default_rng(seed).normal(size=(n_terms, width))
    basis, _ = np.linalg.qr(sums(lambda a: a.T @ (a @ g), n_terms))
    gram = sums(lambda a: (a @ basis).T @ (a @ basis), width)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def _common(masks: dict[int, int], length: int, run: list[int]) -> int:
    """Longest common subsequence with a run, by bit-parallel addition; ``masks`` has the places of
    each word in the other sequence."""
    ones = (1 << length) - 1
    v = ones
    for w in run:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return length - v.bit_count()


def _masks(sequence: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(sequence.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Index:
    """What a task needs to search its documents."""

    def __init__(self, passages: Passages, idf: np.ndarray, vectors: np.ndarray, frequency: np.ndarray):
        self.item = passages.item
        self.latent = (idf[:, None] * vectors).astype(np.float32)  # one row per term
        q = np.stack([self.latent[p].sum(axis=0) for p in passages.words])
        self.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        self.lengths = [len(p) for p in passages.words]
        self.masks = [_masks(p) for p in passages.words]
        self.answers = [(_masks(a), len(a)) for a in passages.answers]
        # rare words by passage: seed_term[seed_at[p]:seed_at[p + 1]], of which ``need`` meet in ``span`` words
        seeds = []
        self.need, self.span = np.zeros((2, len(self.lengths)), np.int64)
        for i, p in enumerate(passages.words):
            common = int(np.ceil(VERBATIM * len(p) - 1e-9))
            places = min(len(p), len(p) - common + SEEDS)
            self.need[i], self.span[i] = places - (len(p) - common), int(len(p) / VERBATIM + 1e-9)
            seeds.append(np.unique(p[np.lexsort((p, frequency[p]))[:places]]))
        self.seed_term = np.concatenate(seeds)
        self.seed_at = np.concatenate(([0], np.cumsum([len(x) for x in seeds])))
        self.is_seed = np.zeros(len(idf), bool)
        self.is_seed[self.seed_term] = True

    def near_copies(self, flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, passage, place of the first rare word) wherever a passage's rare words meet."""
        place = np.flatnonzero(flat >= 0)
        place = place[self.is_seed[flat[place]]]
        place = place[np.argsort(flat[place], kind="stable")]
        counts = np.bincount(flat[place], minlength=len(self.is_seed))
        starts = np.cumsum(counts) - counts
        hits = np.concatenate(([0], np.cumsum(counts[self.seed_term])))[self.seed_at]
        stride = len(flat) + int(self.span.max()) + 1
        lo = 0
        while lo < len(self.lengths):
            hi = max(lo + 1, int(np.searchsorted(hits, hits[lo] + SEED_HITS, side="right")) - 1)
            term = self.seed_term[self.seed_at[lo]:self.seed_at[hi]]
            passage = np.repeat(np.arange(lo, hi), np.diff(hits[lo:hi + 1]))
            key = passage * stride + place[ranges(starts[term], counts[term])]
            key.sort()
            n = np.searchsorted(key, key + self.span[passage]) - np.arange(len(key))
            enough = n >= self.need[passage]
            p, w = passage[enough], key[enough] - passage[enough] * stride
            yield from zip((np.searchsorted(at, w, side="right") - 1).tolist(), p.tolist(), w.tolist())
            lo = hi

    def confirm(self, passage: int, run: list[int], distinct: set[int]) -> tuple[float, float] | None:
        """(share of the passage, share of the answer) that the run has as a subsequence; None
        if they confirm nothing.  The passage's words that occur in the run at all bound the
        subsequence, and settle most candidates."""
        masks, length = self.masks[passage], self.lengths[passage]
        if sum(masks[w].bit_count() for w in masks.keys() & distinct) < PARAPHRASE * length:
            return None
        share = _common(masks, length, run) / length
        if share < PARAPHRASE:
            return None
        answer, n = self.answers[passage]
        replied = _common(answer, n, run) / n
        return (share, replied) if share >= VERBATIM or replied >= ANSWER else None

    def search(self, flat: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, passage, cosine, share, answer share) of the confirmed candidates of some rows."""
        sizes = np.diff(at)
        blocks = -(-sizes // BLOCK)
        # empty blocks part the rows, so that windows are sums of shifted block sums
        first = np.cumsum(blocks + WINDOW - 1) - blocks - WINDOW + 1
        total = int((blocks + WINDOW - 1).sum())
        useful = np.flatnonzero(flat >= 0)
        term = flat[useful]
        row = np.repeat(np.arange(len(sizes)), sizes)[useful]
        block = first[row] + (useful - at[row]) // BLOCK
        sums = np.zeros((total + WINDOW, self.latent.shape[1]), np.float32)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for lo in range(0, len(starts), 512):  # gathers a few megabytes at a time
            here = starts[lo:lo + 512]
            a, b = here[0], starts[lo + 512] if lo + 512 < len(starts) else len(term)
            sums[block[here]] = np.add.reduceat(self.latent[term[a:b]], here - a, axis=0)
        two = sums[:-1] + sums[1:]
        windows = two[:total] + two[2:total + 2]
        windows += sums[4:total + 4]
        row_of = np.repeat(np.arange(len(sizes)), blocks + WINDOW - 1)
        norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        some = np.flatnonzero((norms > 1e-6) & (np.arange(total) < (first + blocks)[row_of]))
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        for lo in range(0, len(some), 4096):
            part = some[lo:lo + 4096]
            cosine = (windows[part] / norms[part, None]) @ self.queries.T.astype(np.float32)
            last = -1
            for w, p in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE))):
                if w != last:
                    last, b, r = w, int(part[w]), int(row_of[part[w]])
                    start = int(at[r]) + (b - int(first[r])) * BLOCK
                    run = flat[max(int(at[r]), start - BLOCK):min(int(at[r + 1]), start + (WINDOW + 1) * BLOCK)]
                    run = run[run >= 0].tolist()
                    distinct = set(run)
                shares = self.confirm(p, run, distinct)
                if shares:
                    key = r, p
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (*shares, float(cosine[w, p])))
        for r, p, w in self.near_copies(flat, at):
            best = found.get((r, p), (0.0, 0.0, 0.0))
            if best[0] == 1.0:
                continue
            start, span = int(at[r]), int(self.span[p])
            run = flat[max(start, w - span + 1):min(int(at[r + 1]), w + span)]
            run = run[run >= 0].tolist()
            shares = self.confirm(p, run, set(run))
            if shares and shares[0] >= VERBATIM:
                b = int(first[r]) + (max(start, w - span + 1) - start) // BLOCK
                cosine = float(windows[b] @ self.queries[p]) / max(float(norms[b]), 1e-6)
                found[r, p] = max(best, (*shares, cosine))
        return [(r, p, c, s, a) for (r, p), (s, a, c) in found.items()]


def _search_pass(docs: DataFrame, blocks: list[Passages]) -> DataFrame | None:
    """Matches of some blocks of passages: the documents are read, and their words numbered and counted,
    once for all of them; each block searches the written numbers with an index of its own."""
    spark = docs.sparkSession
    blocks = [passages for passages in blocks if passages.item]
    if not blocks:
        return None
    vocabulary = np.unique(np.concatenate([passages.vocabulary for passages in blocks]))
    found = materialize_texts(terms(docs, vocabulary), "terms")
    frequencies, total = passage_frequencies(found, len(vocabulary))
    out = None
    for passages in blocks:
        place = np.searchsorted(vocabulary, passages.vocabulary)
        frequency = frequencies[place]
        # positive for every term: in a group of copies an item's words are in a large share of all runs
        idf = np.log((total + 1) / (frequency + 1)) + 0.1
        index = Index(passages, idf, latent_space(spark, passages.words, idf), frequency)
        part = _search_block(found, index, place if len(blocks) > 1 else None, len(vocabulary))
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(found: DataFrame, index: Index, place: np.ndarray | None, n_terms: int) -> DataFrame:
    """Matches of one block in the numbered documents, where its own terms have the numbers ``place``
    (None: the same numbers)."""
    index = found.sparkSession.sparkContext.broadcast((index, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, place = index.value
        if place is not None:
            own = np.full(n_terms + 1, -1, np.int32)  # the last one is for number -1
            own[place] = np.arange(len(place))
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            rows = [(ids[lo + r], search.item[p], c, s, a)
                    for lo, flat, at in _rows_of(batch)
                    for r, p, c, s, a in search.search(flat if place is None else own[flat], at)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(5)],
                    names=["doc_id", "item_id", "cosine", "share", "answer_share"])

    return found.mapInArrow(run, "doc_id long, item_id long, cosine double, share double, answer_share double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_share) of the documents that hold benchmark items:
    one row per pair, with the item's best passage."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), answer.alias("answer"))
    n_blocks = max(1, -(-items.count() // ITEM_BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    out = None
    for first in range(0, n_blocks, PASS_BLOCKS):
        blocks = range(first, min(first + PASS_BLOCKS, n_blocks))
        given: dict[int, list] = {block: [] for block in blocks}
        for *item, block in items.filter(F.col("block").between(blocks[0], blocks[-1])).orderBy("item_id", "text").collect():
            given[block].append(tuple(item))
        found = _search_pass(docs, [Passages(part) for part in given.values()])
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, share double, answer_share double")
    best = F.max(F.struct("share", "answer_share", "cosine"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.cosine", "b.share", "b.answer_share")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
