"""Token ids of many texts at a bounded cost per distinct word.

Both public BPE vocabularies cut a text before a blank that stands before a non-blank
character, whatever comes earlier, around a line feed between two non-blank characters, and
between a letter or digit and the marks (``_TAIL``) that end the word.  A text's ids are therefore
the concatenation of the ids of such pieces.  Arrow splits a slice of texts, each distinct piece
is encoded once by the ``tokenizers`` library (a bounded cache keeps pieces across slices and
tasks) and numpy gathers the ids.  Texts in which white space meets white space, or that
hold an added token of the vocabulary (``<|endoftext|>``), take the library's direct path.  The result equals ``Tokenizer.encode(text, add_special_tokens=False)``
of each whole text.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64, ranges, slices, utf8

#: Pieces that a Python worker keeps, some 100 bytes each; later ones are encoded per slice.
CACHE_PIECES = 1_000_000
#: New pieces join the kept ones in steps of this number, or this share of the kept ones if more.
_STEP_PIECES, _STEP_SHARE = 50_000, 0.25
#: Longer pieces are encoded whenever they are met.
_LONG = 64

#: Stands for a line feed before a piece.
_LINE = "\ue000"
#: A slice holds this much text.
_SLICE = 8 << 20
#: Marks at a piece's end, a word of their own after a letter or digit (an apostrophe need not be).
_TAIL = ".,!?;:%$#&*"
#: Pieces that both vocabularies take as one word.
_LETTERS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+$"
#: Pieces that are empty or start with what some library counts as white space (a line feed
#: with nothing after it, too) send their text down the direct path.
_ODD = r"^$|^\x{e000}?[\s\p{Z}\p{Cc}\p{Cf}]|^\x{e000}$"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """``leading_blank``: the blank belongs to the piece that follows it (byte-level
    vocabulary); False for a vocabulary that drops white space."""

    def __init__(self, path: str, leading_blank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # the library finds these in the raw text, before it cuts it
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.leading_blank = leading_blank
        # marks between pieces that go into one call: tokens of their own that no piece
        # without the mark's character can produce
        self.mark = "\t" if leading_blank else "|"
        self.mark_id, self.line_id = (self.tok.encode(m, add_special_tokens=False).ids[0] if m else 0
                                      for m in (self.mark, "\n" if leading_blank else ""))
        self.known = _Known()
        if leading_blank:
            from tokenizers import pre_tokenizers

            # the vocabulary's spelling of a blank and of letters that are no single byte
            spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.blank = spelt.pre_tokenize_str(" ")[0][0]
            self.spelling = {c: spelt.pre_tokenize_str(chr(c))[0][0] for c in range(0xc0, 0x100)}

    def _direct(self, items: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32)
                for e in self.tok.encode_batch_fast(items, add_special_tokens=False)]

    def _words(self, items: list[str]) -> list[np.ndarray]:
        """(ids, lengths) of words of letters alone, each with its blank: the library would cut them no further."""
        model, ids, lengths = self.tok.model, [], []
        for w in items:
            found = model.tokenize(self.blank + (w if w.isascii() else w.translate(self.spelling)))
            ids += [t.id for t in found]
            lengths.append(len(found))
        return [np.array(ids, np.uint32), np.array(lengths, np.int64)]

    def _joined(self, items: list[str], before: str, mark_id: int) -> list[np.ndarray] | None:
        """Ids of the items, each after the mark, in one call: (ids, lengths without mark)."""
        flat = self._direct([before + before.join(items)])[0]
        is_mark = flat == mark_id
        at = np.flatnonzero(is_mark)
        if len(at) != len(items):
            return None
        return [flat[~is_mark], np.diff(at, append=len(flat)) - 1]

    def _pieces(self, pieces: pa.Array) -> "_Store":
        """Ids of pieces, each with its blank or after its line feed."""
        line = _flags(pc.starts_with(pieces, _LINE))
        apart = _flags(pc.match_substring(pieces, self.mark)) | _flags(pc.match_substring(pieces, "\n"))
        apart |= _flags(pc.equal(pc.utf8_trim(pieces, characters=_LINE), ""))
        word = _flags(pc.match_substring_regex(pieces, _LETTERS)) & ~apart & ~line & self.leading_blank
        groups = {"apart": apart, "line": line & ~apart, "word": word, "plain": ~(apart | line | word)}
        blank = " " if self.leading_blank else ""
        ids, lengths, order = [], [], []
        for kind, chosen in groups.items():
            rows = np.flatnonzero(chosen)
            for lo in range(0, len(rows), 4000):
                part = rows[lo:lo + 4000]
                items = pieces.take(pa.array(part)).to_pylist()
                words = [p.removeprefix(_LINE) for p in items]
                got = None
                if kind == "word":
                    got = self._words(words)
                elif kind == "plain":
                    got = self._joined(words, self.mark + " " if blank else " | ", self.mark_id)
                elif kind == "line":
                    got = self._joined(words, "\n", self.line_id)
                if got is None:
                    each = self._direct([w if p[:1] == _LINE else blank + w for p, w in zip(items, words)])
                    got = [np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))]
                order.append(part)
                ids.append(got[0])
                lengths.append(got[1])
        if not order:
            return _Store()
        return _Store.of_parts(np.concatenate(ids), np.concatenate(lengths), np.concatenate(order))

    def _look_up(self, pieces: pa.Array) -> "_Store":
        """A store that holds the ids of ``pieces`` in their order."""
        keys = _keys(pieces)
        at = self.known.find(pieces, keys)
        hit, missing = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        held = self.known.store.pick(at[hit])
        new = pieces.take(pa.array(missing))
        fresh = self._pieces(new)
        self.known.add(new, keys[missing], fresh)
        return held.then(fresh).placed(np.concatenate((hit, missing)))

    def encode(self, array: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text) of one slice; ``end_id`` is appended to every text."""
        n = len(array)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        marked = np.zeros(n, bool)
        raw = utf8(array)[0].tobytes()
        for mark in (_LINE, *self.added):
            if mark.encode() in raw:
                marked |= _flags(pc.match_substring(array, mark))
        if self.leading_blank:  # a first piece has no blank either; its line feed goes below
            text = pc.binary_join_element_wise(_LINE, pc.replace_substring(array, "\n", " " + _LINE), "")
        else:
            text = pc.replace_substring(array, "\n", " ")
        lists = pc.split_pattern(text, " ")
        counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        pieces = coded.dictionary
        # a piece is a stem and, after a letter or digit, marks
        stems = pc.utf8_rtrim(pieces, characters=_TAIL)
        cut = np.asarray(pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(pieces)),
                                 pc.match_substring_regex(stems, r"[\p{L}\p{N}]$")))
        stems = pc.if_else(pa.array(cut), stems, pieces)
        stem_coded, tail_coded = stems.dictionary_encode(), _tails(pieces, stems, cut).dictionary_encode()
        store = self._look_up(stem_coded.dictionary)
        extra = self._direct(tail_coded.dictionary.to_pylist())
        odd = np.asarray(pc.match_substring_regex(pieces, _ODD))
        direct = (np.add.reduceat(odd[codes], firsts, dtype=np.int64) > 0) | marked
        line = np.asarray(pc.starts_with(pieces, _LINE))
        # codes of a piece: [line feed] stem [tail]
        size = len(store.lengths)
        line_code, end_code = size + len(extra), size + len(extra) + 1
        extra += [np.array([self.line_id], np.uint32), np.array([end_id or 0], np.uint32)]
        seq_len = 1 + line + cut
        seq = np.empty(int(seq_len.sum()), np.int64)
        at = np.cumsum(seq_len) - seq_len
        seq[at[line]] = line_code
        seq[at + line] = np.asarray(stem_coded.indices)
        seq[(at + line + 1)[cut]] = size + np.asarray(tail_coded.indices)
        occurs = seq_len[codes]
        flat = seq[_ranges32(at[codes], occurs)]
        per_text = np.add.reduceat(occurs, firsts)
        keep = np.ones(len(flat), bool)
        text_at = np.cumsum(per_text) - per_text
        if self.leading_blank:  # no line feed stands before a first piece
            keep[text_at] = False
        rows = np.flatnonzero(direct)
        if len(rows):  # such a text becomes one piece
            keep &= ~np.repeat(direct, per_text)
            keep[text_at[rows]] = True
            flat[text_at[rows]] = size + len(extra) + np.arange(len(rows))
            extra += self._direct([array[int(i)].as_py() for i in rows])
        per_text = np.add.reduceat(keep, text_at, dtype=np.int64)
        flat = flat[keep]
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(per_text), end_code)
            per_text = per_text + 1
        store = store.then(_Store.of(extra))
        piece_len = store.lengths[flat]
        out = store.ids[_ranges32(store.starts[flat], piece_len)]
        ends = np.concatenate(([0], np.cumsum(piece_len)))[np.concatenate(([0], np.cumsum(per_text)))]
        return out, ends

    def batches(self, array: pa.Array, end_id: int | None = None):
        """(first row, ids, offsets) for bounded slices of a null-free string array."""
        for lo, hi in slices(array, _SLICE):
            ids, ends = self.encode(array.slice(lo, hi - lo), end_id)
            yield lo, ids, ends


def _ranges32(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``ranges`` for places below 2^31, as they are within a slice's tables."""
    if len(starts) == 0 or max(int(lengths.sum()), int((starts + lengths).max())) >= 1 << 31:
        return ranges(starts, lengths)
    first = (starts - (np.cumsum(lengths) - lengths)).astype(np.int32)
    out = np.repeat(first, lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _flags(array: pa.Array) -> np.ndarray:
    return np.array(array, bool)


def _tails(pieces: pa.Array, stems: pa.Array, cut: np.ndarray) -> pa.Array:
    """What follows the stem in the pieces that are cut."""
    raw, offsets = utf8(pieces)
    rows = np.flatnonzero(cut)
    size = (np.diff(offsets) - np.diff(utf8(stems)[1]))[rows]
    data = raw[ranges(offsets[1:][rows] - size, size)]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(data))


def _keys(pieces: pa.Array) -> np.ndarray:
    """A 64-bit hash of every piece's first ``_LONG`` bytes and its length."""
    raw, offsets = utf8(pieces)
    lengths, starts = np.diff(offsets), offsets[:-1]
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from every place
    out = mix64(lengths.astype(np.uint64))
    for k in range(0, _LONG, 8):
        rows = np.flatnonzero(lengths > k)
        if not len(rows):
            break
        spare = (8 * (8 - np.minimum(lengths[rows] - k, 8))).astype(np.uint64)
        out[rows] = mix64(out[rows] ^ ((words[starts[rows] + k] << spare) >> spare)) + np.uint64(k)
    return out


class _Known:
    """Pieces met before and their ids: found by a hash, then compared whole."""

    def __init__(self):
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.pieces = pa.array([], pa.string())
        self.store = _Store()
        self.waiting: list[tuple[pa.Array, np.ndarray, _Store]] = []
        self.n_waiting = 0

    def find(self, pieces: pa.Array, keys: np.ndarray) -> np.ndarray:
        """Places in ``store``; -1: not known."""
        at = self.index.get_indexer(keys).astype(np.int64)
        hit = np.flatnonzero(at >= 0)
        same = _flags(pc.equal(self.pieces.take(pa.array(at[hit])), pieces.take(pa.array(hit))))
        at[hit[~same]] = -1
        return at

    def add(self, pieces: pa.Array, keys: np.ndarray, store: "_Store") -> None:
        size = len(self.pieces)
        if size >= CACHE_PIECES:
            return
        self.waiting.append((pieces, keys, store))
        self.n_waiting += len(pieces)
        if self.n_waiting < max(_STEP_PIECES, _STEP_SHARE * size):
            return
        pieces = pa.concat_arrays([w[0] for w in self.waiting])
        keys = np.concatenate([w[1] for w in self.waiting])
        store = _Store()
        for w in self.waiting:
            store = store.then(w[2])
        first = np.sort(np.unique(keys, return_index=True)[1])
        first = first[(self.index.get_indexer(keys[first]) < 0) & (np.diff(utf8(pieces)[1])[first] <= _LONG)]
        self.pieces = pa.concat_arrays([self.pieces, pieces.take(pa.array(first))])
        self.index = pd.Index(np.concatenate((self.index.to_numpy(), keys[first])))
        self.store = self.store.then(store.pick(first))
        self.waiting, self.n_waiting = [], 0


class _Store:
    """Id sequences: ``ids[starts[k]:starts[k] + lengths[k]]`` is the k-th."""

    def __init__(self, ids=None, starts=None, lengths=None):
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.starts = np.zeros(0, np.int64) if starts is None else starts
        self.lengths = np.zeros(0, np.int64) if lengths is None else lengths

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> "_Store":
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        return cls(np.concatenate(sequences), np.cumsum(lengths) - lengths, lengths)

    @classmethod
    def of_parts(cls, ids: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> "_Store":
        """Sequences that follow each other in ``ids``, the k-th of them for place ``places[k]``."""
        return cls(ids, np.cumsum(lengths) - lengths, lengths).placed(places)

    def then(self, other: "_Store") -> "_Store":
        return _Store(np.concatenate((self.ids, other.ids)),
                      np.concatenate((self.starts, other.starts + len(self.ids))),
                      np.concatenate((self.lengths, other.lengths)))

    def pick(self, rows: np.ndarray) -> "_Store":
        """These sequences alone."""
        lengths = self.lengths[rows]
        return _Store(self.ids[ranges(self.starts[rows], lengths)], np.cumsum(lengths) - lengths, lengths)

    def placed(self, places: np.ndarray) -> "_Store":
        """The k-th sequence as the ``places[k]``-th."""
        starts, lengths = np.empty_like(self.starts), np.empty_like(self.lengths)
        starts[places], lengths[places] = self.starts, self.lengths
        return _Store(self.ids, starts, lengths)


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, leading_blank: bool) -> WordTokenizer:
    """One tokenizer (and cache of pieces) for all tasks of a Python worker."""
    key = (path, leading_blank)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer(path, leading_blank)
    return _TOKENIZERS[key]
