import zlib

import numpy as np
import pytest
from tallyvane.llm import byte_cnn

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def network(spark):
    return byte_cnn.trained(spark.read.parquet(SF))


def test_held_out_accuracy(spark, network):
    docs = spark.read.parquet(SF)
    found = {r.doc_id: r for r in byte_cnn.identify(docs, network).collect()}
    rows = docs.select("doc_id", "lang", byte_cnn.held_out(docs.doc_id).alias("held")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [found[r.doc_id].lang_pred == r.lang for r in rows if r.held and r.lang]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_tables_equal_the_filters(network):
    gen = np.random.default_rng(1)
    windows = gen.integers(0, byte_cnn.CLASSES, (7, byte_cnn.LENGTH))
    top = []
    for w, f in zip(byte_cnn.WIDTHS, network.filters, strict=True):
        m = byte_cnn.LENGTH - w + 1
        top.append(sum(f[j][windows[:, j : j + m]] for j in range(w)).max(1))
    logit = np.maximum(np.concatenate(top, 1), 0) @ network.dense + network.bias
    chance = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    assert np.allclose(np.exp(network.log_chances(windows)), chance, atol=1e-4)


def test_odd_texts(spark, network):
    texts = [None, "", " ", "123 ... !!", "　", "é", "中文", "the and of with " * 5000]
    docs = spark.createDataFrame([(k, t, None, 5) for k, t in enumerate(texts)] + [(None, "a", "en", 1)] * 2, "doc_id long, text string, lang string, score int")
    rows = {r.doc_id: r for r in byte_cnn.identify(docs, network).collect()}
    assert [rows[k].lang_pred == "und" for k in range(8)] == [True] * 5 + [False] * 3
    assert rows[7].lang_pred == "en"
    assert byte_cnn.identify(docs.limit(0), network).collect() == []
    nothing = byte_cnn.trained(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in byte_cnn.identify(docs, nothing).collect()} == {("und", 0.0)}
