import zlib

import numpy as np
import pytest

from leadlens.llm import rangecoder, token_output
from leadlens.llm.common import crc32_shift
from leadlens.llm.tokenize import vocabulary_path


@pytest.mark.parametrize("n", [0, 1, 63, 64, 130, 5000])
@pytest.mark.parametrize("k", [1, 3, 50_257])
def test_range_coder_round_trip(n, k):
    ids = np.random.default_rng(n + k).integers(0, k, n).astype(np.uint32)
    assert np.array_equal(rangecoder.decode(rangecoder.encode(ids, 50_257)), ids)


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(200, dtype=np.uint32), 300)
    payload = rangecoder.encode(ids, 50_257)
    assert 8 * len(payload) < 4 * len(ids)  # under 4 bits for each of 16
    for damaged in (payload[:-2], b"x" + payload[1:], payload[:-9] + bytes([payload[-9] ^ 1]) + payload[-8:]):
        with pytest.raises(ValueError):
            rangecoder.decode(damaged)
    with pytest.raises(ValueError):
        rangecoder.encode(ids, 100)


def test_crc_of_a_concatenation():
    rng = np.random.default_rng(1)
    for a, b in ((0, 5), (7, 0), (3, 1000), (100, 77777)):
        x, y = rng.bytes(a), rng.bytes(b)
        assert zlib.crc32(x + y) == crc32_shift(zlib.crc32(x), b) ^ zlib.crc32(y)


def expect(rows, end_id=2):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [16, 1 << 20])
def test_files_read_back(spark, tmp_path, block_ids):
    rows = [(9, "one # two"), (3, None), (1, ""), (5, "long " * 100), (5, "long " * 100), (5, "another"), (None, "x"), (2, "b\n\na  c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, start int").repartition(3)
    path = str(tmp_path / "out")
    token_output.write(docs, path, vocabulary_path("byte_bpe_50k.json"), block_ids=block_ids)
    got = [tuple(r) for r in token_output.documents_of(spark, path).orderBy("start").collect()]
    assert got == expect(rows)
    pieces = token_output.read(spark, path, with_ids=True).collect()
    assert sum(len(p.ids) for p in pieces) == sum(g[2] for g in got)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_output.write(docs, path, vocabulary_path("byte_bpe_50k.json"))
    assert token_output.documents_of(spark, path).collect() == []


def test_query(spark):
    from tests.conftest import SF_SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in token_output.query(spark, SF_SMALL).orderBy("start").collect()] == expect(rows)


def test_added_tokens_read_back(spark, tmp_path):
    rows = [(1, "end <|endoftext|> next"), (2, "a<|endoftext|>"), (3, "later <|startoftext|> text")]
    path = str(tmp_path / "out")
    token_output.write(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary_path("byte_bpe_50k.json"))
    assert [tuple(r) for r in token_output.documents_of(spark, path).orderBy("start").collect()] == expect(rows)


def test_known_pieces_are_compared_whole_and_ids_found_by_cells(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from leadlens.llm import tokenize

    path = vocabulary_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ["plain words, and éàß ñandú!!", "ends.$$$ here### 3.5% it's don't.,", "w" * 300 + ". " + "é" * 40 + "?", "one\nTwo!!\nthree ***"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokenize, "_STEP_PIECES", 2)
    for keys in (tokenize._keys, lambda pieces: np.zeros(len(pieces), np.uint64)):  # all keys alike
        monkeypatch.setattr(tokenize, "_keys", keys)
        tok = tokenize.WordTokenizer(path, True)
        for _ in range(3):
            ids, ends = tok.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
        assert len(tok.known.pieces) == len(set(tok.known.index)) > 0
        assert max(map(len, tok.known.pieces.to_pylist())) <= tokenize._LONG

    model = rangecoder.Model(500, 8)
    model.counts += (np.arange(500) % 7 == 0).astype(np.uint64) * np.uint64(100_000)
    np.cumsum(model.counts, out=model.cumulative[1:])
    value = np.unique(np.concatenate((model.cumulative[:-1], model.cumulative[1:] - np.uint64(1), model.cumulative[:-1] // np.uint64(2))))
    assert np.array_equal(model.find(value), np.searchsorted(model.cumulative, value, side="right") - 1)
