import random
import zlib

import numpy as np
import public_tokenizers
from tallyvane.llm import shared, token_store

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_key_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000)).astype(np.int64)
    index = token_store.KeyIndex.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    offsets = np.arange(len(keys) + 1)
    shard = token_store.ShardIndex.from_bytes(token_store.ShardIndex.build(keys, offsets, 2).to_bytes())
    assert (shard.ordinals(keys, np.zeros(len(keys), int)) == np.arange(len(keys))).all()
    others = np.random.default_rng(2).integers(-(2**62), 2**62, 5000)
    assert (shard.ordinals(others, np.zeros(5000, int)) < 0).mean() > 0.99


def test_round_trip_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = [
        "Hello  World it's", None, "", "a b <|endoftext|>x é ́ \x1cq", "x" * 5000, "ABC def " * 3000, "ΣΣ İ\n\n123",
        "é. x×. É, e\u0301. it's. 'S! a.b. <|ENDOFTEXT|>. 1.5, ...! ñ%%% n***\nq|",
    ]
    rows = [(k * 7 % 60, texts[k % 8], "other", k) for k in range(60)] + [(3, "tie", "x", 1), (3, "tie", "x", 1), (None, "no key", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string, shard int").repartition(5)
    got = token_store.read(token_store.write(docs, shared.folder(spark, "t"), PATH, end=2)).collect()
    start, expected = 0, []
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").distinct().collect()}
    for key, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected


def test_words_against_the_library(monkeypatch):
    """Random strings, with a cache that starts anew several times."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "CACHE_WORDS", 300)
    library, encoder, rng = Tokenizer.from_file(PATH), token_store.Encoder(PATH, 2, 2), random.Random(4)
    parts = ["a", "B", "é", "É", "×", "÷", "1", ".", ",", "!", "|", "*", " ", "  ", "\t", "\n", "\x1c", "'s", "<|", "|>", "<|endoftext|>", "-", "́", "语", "word", "İ"]
    for _ in range(40):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 8, 60]))) for _ in range(rng.choice([1, 30]))]
        ids, n = encoder.encode([None if t is None else t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.read(token_store.write(docs, shared.folder(spark, "t"), PATH, end=2)).collect() == []
