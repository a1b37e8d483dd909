"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_byte_bpe_round_trip(spark, sf_dir):
    from tallyvane.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


def op2_toxicity(spark, sf_dir):
    from tallyvane.llm import toxicity

    docs = documents(spark, sf_dir)
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


def op3_line_quality(spark, sf_dir):
    from tallyvane.llm import line_crf

    docs = documents(spark, sf_dir)
    field = line_crf.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.score(docs, field)


def op5_near_duplicates(spark, sf_dir):
    from tallyvane.llm import jaccard_join

    return jaccard_join.join(documents(spark, sf_dir))


#: All pairs of documents that share a shingle, and what their links reach.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)
), z AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM common JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN z USING (doc_id) JOIN reached ON a = doc_id GROUP BY doc_id
"""


def op6_fixity_audit(spark, sf_dir):
    """Pages as an archive against a replica where some bodies have lost their last characters and some files their ends."""
    from tallyvane.llm import shared, warc_fixity

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    good = shared.written(warc_fixity.layout(warc_fixity.render(pages)), "archive")
    worn = pages.withColumn("html", F.when(F.col("page_id") % 97 == 13, F.col("html").substr(F.lit(1), F.length("html") - 3)).otherwise(F.col("html")))
    cut = (F.floor(F.col("page_id") / 256) % 7 == 3) & (F.col("page_id") % 256 >= 250)
    other = shared.written(warc_fixity.layout(warc_fixity.render(worn.filter(F.coalesce(~cut, F.lit(True))))), "archive")
    found = warc_fixity.damaged(good, other)
    return found.join(good, ["file", "ordinal"]).select("file", "ordinal", F.col("key").alias("page_id"), "offset", "length", "kind")


#: The same records from sizes alone: a body that shrinks moves the offsets of the records after it in its file.
OP6_SQL = r"""
WITH sized AS (
  SELECT page_id, page_id // 256 AS file, html, url,
    strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
      || chr(13) || chr(10) || chr(13) || chr(10)) + strlen(coalesce(html, '')) + 4 AS length,
    page_id % 97 = 13 AS worn,
    (page_id // 256) % 7 = 3 AND page_id % 256 >= 250 AS cut
  FROM pages
), placed AS (
  SELECT *, row_number() OVER w - 1 AS ordinal,
    coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
    coalesce(bool_or(worn) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS moved
  FROM sized WINDOW w AS (PARTITION BY file ORDER BY page_id)
)
SELECT file, ordinal, page_id, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
  CASE WHEN cut THEN 'missing' WHEN worn THEN 'changed' ELSE 'moved' END AS kind
FROM placed WHERE cut OR moved
"""


def op7_benchmark_hits(spark, sf_dir):
    from tallyvane.llm import decontaminate

    paths = decontaminate.prepare(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = decontaminate.search(documents(spark, sf_dir), paths)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: The same windows as strings of words, joined.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
), x AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), h AS (SELECT doc_id, item, n, k FROM x JOIN i USING (n, s)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM h) GROUP BY doc_id
), items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_language(spark, sf_dir):
    from tallyvane.llm import byte_cnn

    docs = documents(spark, sf_dir)
    found = byte_cnn.identify(docs, byte_cnn.trained(docs))
    return found.withColumn("held_out", byte_cnn.held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")


def op9_repeated_passages(spark, sf_dir):
    from tallyvane.llm import substring_dedup

    return substring_dedup.digests(documents(spark, sf_dir))


#: The same windows as strings of words, the first of each string kept.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(w[k:k + 19], ' ') ORDER BY doc_id, k) AS r
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS k FROM d WHERE len(w) >= 20)
), removed AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + 19)) AS p FROM x WHERE r > 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_token_counts(spark, sf_dir):
    from tallyvane.llm import transducer

    return transducer.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op1_token_shards(spark, sf_dir):
    from tallyvane.llm import shared, token_store

    path = public_tokenizers.path("word_bpe_49k.json")
    table = token_store.write(documents(spark, sf_dir), shared.folder(spark, "token-shards-ids"), path, end=2)
    return token_store.read(table)


def op11_conversation_trie(spark, sf_dir):
    from tallyvane.llm import prefix_trie

    placed, spans = prefix_trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.trie(*prefix_trie.rebuilt(placed, spans))


#: Prefixes as joined digests; a node's ancestors are the shorter prefixes of its smallest member. CRC-32 bit by bit.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT c, list(m ORDER BY k) AS s, list(w ORDER BY k) AS ws FROM t GROUP BY c
), x AS (
  SELECT c, s, ws, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1))))) % 4 AS h
  FROM o
), b AS (
  SELECT x.c, list_concat(coalesce(o.s, [])[1:h], x.s[h + 1:]) AS s, list_concat(coalesce(o.ws, [])[1:h], x.ws[h + 1:]) AS ws
  FROM x LEFT JOIN o ON o.c = x.c - x.c % 20
), n AS (SELECT c, d, len(s) AS l, array_to_string(s[1:d], ',') AS p, array_to_string(s[1:d - 1], ',') AS q, ws[d] AS w FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM b)
), g AS (
  SELECT d, p, any_value(q) AS q, coalesce(any_value(w), 0) AS w, min(c) AS c, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = l) AS ends FROM n GROUP BY d, p
), k AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL
), own AS (SELECT c, d, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * w AS saved FROM g LEFT JOIN k USING (d, p)
), below AS (SELECT n.d, n.p, sum(leaf) AS leaves, sum(saved) AS saved FROM own JOIN n ON own.c = n.c AND n.d <= own.d GROUP BY ALL)
SELECT g.c AS conv_id, g.d AS depth, up.c AS parent_conv_id, g.n AS n_convs, coalesce(n_children, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN below USING (d, p) LEFT JOIN k USING (d, p) LEFT JOIN g up ON up.d = g.d - 1 AND up.p = g.q
"""


def op12_text_likelihood(spark, sf_dir):
    from tallyvane.llm import ppm

    found = ppm.scored(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return found.withColumn("held_out", ~F.col("learns")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_token_alignment(spark, sf_dir):
    from tallyvane.llm import alignment

    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.summarised(documents(spark, sf_dir), *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op2_toxicity": op2_toxicity,
        "op3_line_quality": op3_line_quality,
        "op5_near_duplicates": op5_near_duplicates,
        "op8_language": op8_language,
        "op6_fixity_audit": op6_fixity_audit,
        "op7_benchmark_hits": op7_benchmark_hits,
        "op9_repeated_passages": op9_repeated_passages,
        "op1_token_shards": op1_token_shards,
        "op10_token_counts": op10_token_counts,
        "op4_byte_bpe_round_trip": op4_byte_bpe_round_trip,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_text_likelihood": op12_text_likelihood,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_near_duplicates": OP5_SQL, "op11_conversation_trie": OP11_SQL, "op6_fixity_audit": OP6_SQL, "op7_benchmark_hits": OP7_SQL, "op9_repeated_passages": OP9_SQL}
