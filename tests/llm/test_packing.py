import zlib
from collections import defaultdict

import numpy as np
import pytest

from leadlens.llm import packing
from leadlens.llm.tokenize import WordTokenizer, vocabulary_path


@pytest.mark.parametrize("vocabulary,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_join_to_the_library_encoding(vocabulary, blank):
    import pyarrow as pa

    tok = WordTokenizer(vocabulary_path(vocabulary), blank)
    items = ["", " ", "  a", "a  b", "a \n b", " lead", "trail ", "don't  stop, he's.", "a\tb \tc", "x <|endoftext|> y",
             "\n", "　 z", "é ́x", "ΑΣ Σ", "1234 56, 789.", "a\n\nb", "a\nb", "a.\nB, c,.\n", "...", "\na",
             "ab", "a |b| c|", "\t", "x,", "A.B, c"] * 2
    ids, ends = tok.encode(pa.array(items))
    again, _ = tok.encode(pa.array(items))  # from the cache
    assert np.array_equal(ids, again)
    for i, text in enumerate(items):
        assert ids[ends[i]:ends[i + 1]].tolist() == tok.tok.encode(text, add_special_tokens=False).ids, repr(text)


def brute_best_fit(lengths, window):
    capacity = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(capacity) if c >= n]
        if fits:
            capacity[min(fits)[1]] -= n
        else:
            capacity.append(window - n)
    return sorted(capacity)


def test_best_fit_decreasing_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        window = int(rng.integers(1, 40))
        lengths = rng.integers(1, window + 1, int(rng.integers(0, 60)))
        sequence, offset, new = packing.best_fit_decreasing(lengths, window, 5)
        used = defaultdict(int)
        for s, n in zip(sequence, lengths):
            used[s] += int(n)
        assert sorted(window - u for u in used.values()) == brute_best_fit(lengths.tolist(), window)
        assert new == 5 + len(used)
        check_gapless(sequence, offset, lengths, window)


def check_gapless(sequence, offset, length, window):
    by = defaultdict(list)
    for s, o, n in zip(sequence, offset, length):
        by[s].append((o, n))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window


def test_pack_whole_documents(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello there, world", "x"), (2, None, "x"), (3, "", "x"), (4, "one two three four " * 40, "x"),
            (4, "one two three four " * 40, "x"), (None, "lost id", "x"), (7, "a  b\n c", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sequence_id string").repartition(2)
    path = vocabulary_path("word_bpe_49k.json")
    got = packing.pack(docs, path, window=32, with_ids=True).collect()
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got], 32)
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert all(r.padded_length == (used[r.sequence_id] if used[r.sequence_id] in (1, 2, 4, 8, 16) else 32) for r in got)
    assert packing.padded_lengths(np.array([9, 9, 7, 8]), np.array([3, 5, 6, 4096]), 4096).tolist() == [8, 8, 4096, 4096]
    tok = Tokenizer.from_file(path)
    want = sorted((str(d), tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows)
    joined = defaultdict(list)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.start)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        joined[str(r.doc_id)].append(r)
    for doc, pieces in joined.items():
        copies = [ids for d, ids in want if d == doc]
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        assert all(r.doc_tokens == len(copies[0]) and r.ids == copies[0][r.start:r.start + r.length] for r in pieces)
    assert packing.pack(docs.limit(0), path).collect() == []


def test_groups_bound_memory_and_keep_sequences_apart(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('word ', cast(id as int)) as text").coalesce(1)
    got = packing.pack(docs, vocabulary_path("word_bpe_49k.json"), window=64, group_ids=1000).collect()
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got], 64)
    assert sum(r.length for r in got) == sum(n + 1 for n in range(200))


ADDED = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b, c.", "x <|startoftext|> y", "<|startoftext|><|endoftext|>.", "a\n<|endoftext|>\nb",
         "<|ENDOFTEXT|> a", "<|endoftext |>", "< |endoftext|>", "plain text, here."]


@pytest.mark.parametrize("vocabulary,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_as_the_library_encodes_them(vocabulary, blank):
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path(vocabulary))
    tok = WordTokenizer(vocabulary_path(vocabulary), blank)
    for _ in range(2):  # then from the cache
        ids, ends = tok.encode(pa.array(ADDED * 2))
        for i, text in enumerate(ADDED * 2):
            assert ids[ends[i]:ends[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids)[:-1] for r in packing.pack(docs, vocabulary_path("word_bpe_49k.json"), with_ids=True).collect()}
    assert got == {i: plain.encode(t, add_special_tokens=False).ids for i, t in enumerate(ADDED)}
