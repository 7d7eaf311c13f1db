import os
import random

import pytest

pytest.importorskip("readroute.llm.queries")

from readroute.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="the tokenizer file is not here")

TEXTS = [
    None, "", " ", "\n\n  x", "hello world, it's 2024!", "<|endoftext|> is text", "日本語のテスト 😀😀", "é    \x1c\x85 end  ", "a" * 5000, "=-" * 2000, " " * 3000 + "x",
    "don't we'll I'M 'S", "1²½Ⅷ٣ x̶", "퟿﻿​", "def f(x):\n\treturn x**2\r\n",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_and_round_trip(spark, reference):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcdefgh ABC019,.\n") for _ in range(rng.randrange(300))) for _ in range(60)] + ["".join(rng.choice("abcdefghijklm") for _ in range(3000))]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts * 2)], "id int, text string, `my.col` int")
    coded = bpe.encode(df, "text").cache()
    rows = coded.collect()
    assert len(rows) == 2 * len(texts) and coded.columns == ["id", "my.col", "ids"]
    for r in rows:
        assert list(r.ids) == reference(texts[r.id % len(texts)]), r.id
    for r in bpe.decode(coded, "ids").collect():
        assert r.text == (texts[r.id % len(texts)] or "")
    counts = {r.id: r.n_tokens for r in bpe.count_tokens(df, "text").collect()}
    assert counts == {r.id: len(r.ids) for r in rows}


def test_names_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, "a")], "ids int, text string")
    with pytest.raises(ValueError):
        bpe.encode(df, "text")
    assert bpe.encode(df.limit(0).drop("ids"), "text").count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), "ids").collect()


def test_slices_hold_all_rows():
    import pyarrow as pa

    lists = [["x"] * n for n in (0, 5, 1, 0, 40, 2, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["i", "p"])
    for most in (1, 6, 100):
        assert [x for b in bpe._slices(batch.slice(1), most) for x in b.column(0).to_pylist()] == list(range(1, len(lists)))


def test_both_queries_agree():
    encoder = bpe.Encoder(bpe.Merges(bpe.VOCABULARY))
    raw = [w.encode() for w in (" hello", "aaaaaaa", "banana", "=====", "mississippi", "zzzzzzzzzzzz")]
    first, second = ({w: ids.tolist() for w, ids in encoder._run(raw, sql)} for sql in (bpe.LEFTMOST, bpe.EVERYWHERE))
    assert first == second and len(first) == len(raw)


def test_many_long_words_stay_in_memory(reference, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(60)] + ["ab" * 20_000]
    encoder = bpe.Encoder(bpe.Merges(bpe.VOCABULARY))
    encoder.learn(words)
    assert all(encoder.known[w].tolist() == reference(w) for w in words)
    assert not list(tmp_path.iterdir())


def test_pieces_are_encoded_by_themselves(reference):
    merges = bpe.Merges(bpe.VOCABULARY)
    word = "qzXj9vQkZw" * 30
    pieces = merges.pieces(word.encode())
    assert len(pieces) > 20 and b"".join(pieces) == word.encode()
    assert [i for p in pieces for i in reference(p.decode())] == reference(word)
