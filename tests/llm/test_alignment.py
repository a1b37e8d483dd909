"""Token alignment against loops over the libraries' tokens."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tallyvane.llm import alignment, queries
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def readable():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(extra)] = b
            extra += 1
    return out


BYTE = readable()


def tokens(libraries, text):
    """(id, begin, end) of both sides."""
    if not text:
        return [], []
    first, second = libraries
    raw = (" " + text).encode()
    a = [(k, bytes(BYTE[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(k, bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode()) for k in second.encode(text) for p in [second.id_to_piece(k)]]
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return [], []
    out = []
    for side in (a, b):
        at, rows = 0, []
        for k, x in side:
            rows.append((k, at, at + len(x)))
            at += len(x)
        out.append(rows)
    return tuple(out)


def grouped(a, b):
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    out, begin = [], 0
    for end in ends:
        out.append(([k for k, s, e in a if begin <= s < end], [k for k, s, e in b if begin <= s < end]))
        begin = end
    return out


def expected(libraries, rows):
    groups = [(key, grouped(*tokens(libraries, text))) for key, text in rows]
    df = Counter()
    for _, gs in groups:
        df.update({(x, y) for a, b in gs for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in df.items():
        most[x] = max(most[x], n)
    out = []
    for key, gs in groups:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in gs)
        digest = hashlib.sha256(text.encode()).hexdigest() if gs else ""
        out.append((key, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(df[p] == most[p[0]] for p in links), sum(df[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    (1, "Hello, world! <|endoftext|> <s> isn't"),
    (2, None),
    (3, ""),
    (4, "日本語のテキスト、ทดสอบ 🙂🙂"),
    (5, "  two  spaces\tand\nlines   "),
    (6, "Hello, world! <|endoftext|> <s> isn't"),
    (6, "Hello, world! <|endoftext|> <s> isn't"),
    (None, "a"),
    (8, "▁ marks"),
    (9, "zqxj" * 300 + "💥" * 200),
]


def test_small_texts(spark, libraries):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in TEXTS], "doc_id int, text string, pairs string, block int")
    want = expected(libraries, TEXTS)
    got = alignment.summarised(docs, *PATHS).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert alignment.summarised(docs.limit(0), *PATHS).collect() == []


def test_overlaps(spark, libraries):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] != 6], "doc_id int, text string")
    want = []
    for key, text in TEXTS:
        if key == 6:
            continue
        a, b = tokens(libraries, text)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        for i, (x, s, e) in enumerate(a):
            for j, (y, t, f) in enumerate(b):
                if max(s, t) < min(e, f):
                    want.append((key, i, j, x, y, max(s, t), min(e, f), sum(z <= max(s, t) for z in ends)))
    assert sorted(map(tuple, alignment.overlaps(docs, *PATHS).collect()), key=str) == sorted(want, key=str)


def test_blocks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 300)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    rows = [(k, f"line {k} of {k % 7} words " * (k % 4)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    assert sorted(map(tuple, alignment.summarised(docs, *PATHS).select(COLUMNS).collect()), key=str) == expected(libraries, rows)


def test_long_groups_and_short_memory(monkeypatch):
    both = alignment.loaded(*PATHS)
    texts = [t for _, t in TEXTS] * 2
    want = alignment._of_docs(texts, both)
    monkeypatch.setattr(alignment, "LONG_GROUP", 2)
    for most in (8 << 20, 5):  # characters kept: all, or next to none
        monkeypatch.setattr(alignment, "MOST_CHARACTERS", most)
        for k in (1, 3, len(texts)):
            found = [alignment._of_docs(texts[a : a + k], both) for a in range(0, len(texts), k)]
            for column, parts in zip(want, zip(*found, strict=True), strict=True):
                assert [x for p in parts for x in (p.tolist() if hasattr(p, "tolist") else p.to_pylist())] == (column.tolist() if hasattr(column, "tolist") else column.to_pylist())


def test_query_against_the_libraries(spark, libraries):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = queries.op13_token_alignment(spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(libraries, rows)
