import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tallyvane.llm import bpe, transducer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(7)
CHARACTERS = " \n\t'abcdefst  rev ll 12,.!?éüß中文́  \x85\x1c​😀ÀaaaAAA"
TEXTS = [
    None, "", "a" * 3000, "ab" * 2000, " " * 500 + "x", "\n" * 40, "a<|endoftext|> b<|endoftext|>", "x'r", "'re", "'", "it's we'll",
    *("".join(rng.choices(CHARACTERS, k=rng.randint(0, 60))) for _ in range(400)),
    *("".join(rng.choices("' srevl\n!1a", k=rng.randint(0, 12))) for _ in range(400)),
    *(chr(c) + "a" + chr(c) * 2 + " " + chr(c) + "b" for c in range(0, 0x3000, 7)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "tie", "x", 1)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens int").repartition(3)


def test_blocks_keep_all_rows_in_order():
    texts = [rng.choice(["", None, "x" * rng.randint(0, 50)]) for _ in range(500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[a:b], pa.string())], names=["t"]) for a, b in ((0, 0), (0, 90), (90, 91), (91, 500))]
    for size in (1, 20, 400, 10**9):
        tables = list(bpe.blocks(iter(batches), "t", size))
        assert [x for t in tables for x in t.column("t").to_pylist()] == texts
        assert all(sum(len(x or "") for x in t.column("t").to_pylist()) <= size + 50 for t in tables)


def test_round_trip_against_the_library(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN).collect():
        text = "tie" if row.doc_id is None else TEXTS[row.doc_id] or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert (row.n_tokens, bytes(row.decoded)) == (len(row.ids) // 4, text.encode())
    found = {r.doc_id: r for r in bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect()}
    assert found[0].ids_sha256 == found[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_words_whose_replay_is_not_monotone():
    """A vocabulary where a merge makes a pair of lower rank: the leftmost pair of least rank must go first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"cab": 259, b"aa": 260, b"aaa": 261}
    replay = bpe.MergeReplay(ranks)
    words = [bytes(rng.choices(b"abc", k=rng.randint(0, 12))) for _ in range(2000)]
    for word, ids in zip(words, replay.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == replay.encode_one(word)


def test_counts_against_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    for row in transducer.token_counts(docs, FILE, limit=20).collect():
        text = "tie" if row.doc_id is None else TEXTS[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 20), text


def test_empty_table(docs):
    assert bpe.encode_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
    assert transducer.token_counts(docs.limit(0), FILE, limit=1).collect() == []


def test_states_stay_bounded(monkeypatch):
    """Words without end, as of scripts without spaces, in one block."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(transducer, "MOST_STATES", 300)
    library, compiled = Tokenizer.from_file(FILE), transducer.Tokenizer(FILE)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "".join(rng.choices("中文字符没有空格的长句子", k=3000)), "some words, as ever"]
    assert compiled.count(texts)[1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(compiled.counter.states) < 300 + transducer.LANES + 256
