"""Packing and token counts against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import packing, tokens
from millrace.llm._common import buffers

ODD = ["", " ", "  ", "a  b", "   x", "\x1c b\x1d", "it's  I'll\n\n x", "<|endoftext|> a<|endoftext|>", "</s> <s>", "<0x0A>\n", "日本語のテキスト  漢字", "🙂🙂 x🙂", "x" * 3000 + " " * 70 + "y", "\x00\x01é", "▁" * 40 + "abc", " \x85 x\xa0 y", "\t\tif (x) {", "naïve, Ünï. ,x"]


def texts(n=300):
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("ab eth  ▁ing1.,'\n日é\xa0🙂rnoud") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_byte_level_ids_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.ByteLevelIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = texts()
    ids, first = own.ids(*buffers(pa.array(rows)))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_patterned_texts_have_ids_of_their_own(monkeypatch):
    """Words whose polynomial hashes are equal for any odd base: the Thue-Morse word and its complement."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [word, word.translate(str.maketrans("ab", "ba")), "x" * 4000 + " y " * 900]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert want[0] != want[1]
    for step in (2 << 20, 64):
        monkeypatch.setattr(packing, "STEP_BYTES", step)
        ids, first = packing.ByteLevelIds(path, public_tokenizers.path("byte_bpe_50k.tiktoken")).ids(*buffers(pa.array(rows)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


@pytest.mark.parametrize("chunk", [1, 3, 50, tokens.CHUNK])
def test_transducer_counts_equal_the_library(chunk):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = tokens.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts(150):
        assert own.count(t, chunk) == len(library.encode(t)), t


def test_transducer_forgets_and_still_counts(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for name in ("MAX_WORDS", "MAX_STATES", "MAX_PAIRS"):
        monkeypatch.setattr(tokens, name, 3)
    own, library = tokens.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert [own.count(t) for t in ODD] == [len(x) for x in library.encode(ODD)]


def test_long_words_are_counted_by_composed_maps(monkeypatch):
    import base64

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = tokens.PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    chinese = "".join(rng.choice("中文没有空格的长文本测试日本語カナ") for _ in range(20_000))
    for t in (chinese, base64.b64encode(rng.randbytes(30_000)).decode(), "a" * 9999, "▁" * 700, " " * 333 + "end", chinese + " " + "ab" * 5000 + "  "):
        assert own.count(t) == len(library.encode(t))
    # Guesses that are often wrong change nothing: compositions ask for the right entry state.
    monkeypatch.setattr(tokens, "BEFORE", 0)
    assert own.count(chinese) == len(library.encode(chinese))


def test_sum_of_squares_choice():
    p = packing.LevelPacker(10, 0)
    p.count[[4, 6]] = [3, 1]
    # 4 -> 8 changes the sum by 2 (0 - 3) + 2, 6 -> 10 closes a window: 1 - 2, a new one adds 2 * 3 + 1.
    assert p.best_level(4) == 4
    p.count[[4, 6]] = [1, 3]
    assert p.best_level(4) == 6
    p.count[:] = 0
    assert p.best_level(4) == 0


@pytest.mark.parametrize("max_open", [4, 8192])
def test_windows_hold_each_id_once(max_open):
    rng = np.random.default_rng(0)
    p = packing.LevelPacker(64, 100, max_open)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in rng.integers(1, 200, 400)]
    for k, ids in enumerate(docs):
        p.add(k, ids.tobytes())
    p.close()
    fills = [sum(len(x[2]) // 4 for x in pieces) for _, pieces in p.closed]
    assert max(fills) <= 64 and len({s for s, _ in p.closed}) == len(p.closed)
    assert sum(f < 64 for f in fills) <= 1
    back = {k: {} for k in range(len(docs))}
    for _, pieces in p.closed:
        for doc, start, ids, total in pieces:
            assert total == len(docs[doc])
            back[doc][start] = np.frombuffer(ids, "<u4")
    for k, ids in enumerate(docs):
        assert np.array_equal(np.concatenate([back[k][s] for s in sorted(back[k])]), ids)


def test_packed_table(spark):
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts(60))] + [(None, None, "c", 2), (3, "dup", "c", 3), (3, "dup", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(3)
    got = packing.pack_sum_of_squares(docs, window=128).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)
    assert got["length"].sum() == sum(want)
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].tolist() == [0, *window["length"].cumsum()[:-1]] and window["length"].sum() <= 128
    one = got[got.doc_id == 12].sort_values("start")
    assert np.concatenate([np.frombuffer(x, "<u4") for x in one["ids"]]).tolist() == [*library.encode(rows[12][1], add_special_tokens=False).ids, 1]
    assert packing.pack_sum_of_squares(docs.limit(0)).count() == 0


def test_counted_table(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 5), (2, "", 5), (None, "x" * 9000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tokens.count_tokens(docs, limit=100).collect()), key=str)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = len(library.encode("x" * 9000))
    assert got == sorted([(1, 3, 2, False), (2, 0, 0, False), (2, 0, 0, False), (None, 9000, n, n > 100)], key=str)
    assert tokens.count_tokens(docs.limit(0)).count() == 0
