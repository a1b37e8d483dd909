"""Models that plug in, and records with lines that don't fit."""

from pyspark.sql import functions as F
from tallyvane.operators import answering, chunking, models, search
from tallyvane.sources import records, storage


def corpus(spark):
    texts = ["revenue total 5,000", "total costs of the year", "other words entirely", "revenue revenue total assets", "assets at year end"]
    docs = spark.createDataFrame([("p", k, t, "final" if k else "draft") for k, t in enumerate(texts)], "part string, doc int, text string, status string")
    queries = spark.createDataFrame([("a", "p", "what is total revenue"), ("b", "p", "assets")], "query string, part string, text string")
    return docs, queries


def test_a_model_that_says_what_words_say_changes_nothing(spark):
    docs, queries = corpus(spark)

    def letters(texts):
        return [[float(t.count(c)) for c in "aeiost"] for t in texts]

    docs, queries = models.embedded(docs, letters), models.embedded(queries, letters)
    assert docs.filter("error IS NOT NULL").count() == 0
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in docs.collect())
    index = search.build(docs)
    plain = search.hybrid(index, docs, queries, 5)
    assert plain.filter("dense_rank IS NULL").count() == 0
    known = {(r.query, r.doc): r.rerank for r in plain.collect()}
    text = {r.text: r.doc for r in docs.collect()}
    name = {r.text: r.query for r in queries.collect()}

    def same(asked, found):
        return [known[name[q], text[t]] for q, t in zip(asked, found, strict=True)]

    own = search.hybrid(index, docs, queries, 5, model=same)
    assert own.filter("model_error IS NOT NULL").count() == 0
    assert sorted(map(tuple, own.drop("model_error").collect())) == sorted(map(tuple, plain.collect()))
    # One that prefers the third document, and one that can't score the second query.
    odd = search.hybrid(index, docs, queries, 1, model=lambda q, t: [9.0 if "other" in x else 0.0 for x in t])
    assert {r.query: r.doc for r in odd.collect()} == {"a": 2, "b": 2}

    def fails(asked, found):
        if "assets" in asked:
            raise ValueError("no score")
        return same(asked, found)

    failed = models.reranked(plain.select("query", "part", "doc", "rerank"), docs, queries, fails, batch=1)
    assert sorted(map(tuple, failed.select("query", "doc", "rerank").collect())) == sorted((q, d, v) for (q, d), v in known.items())
    assert {(r.query, r.model_error) for r in failed.collect()} == {("a", None), ("b", "ValueError: no score")}


def test_values_that_dont_fit_are_errors_of_their_batch(spark):
    rows = spark.range(5).coalesce(1).select("id", F.col("id").cast("string").alias("text"))
    got = models.applied(rows, ["text"], lambda t: t[:1], "string", batch=2).orderBy("id").collect()
    assert [(r.value, r.error) for r in got] == [(None, "1 values for 2 rows")] * 4 + [("4", None)]
    assert models.applied(rows.limit(0), ["text"], lambda t: t, "string").collect() == []


def test_a_judge_of_ones_own(spark):
    questions = spark.createDataFrame([("1", "d", "What was revenue?"), ("2", "d", "What was equity?")], "question string, deal string, text string")
    contexts = spark.createDataFrame([(q, 1, "a.pdf", 1, "Revenue was 5,000\nEquity was 7,000") for q in "12"], "question string, rank int, document string, page int, text string")
    answers = answering.answered(questions, contexts)
    facts = spark.createDataFrame([("1", "a.pdf", 1, "5,000", True), ("2", "a.pdf", 1, "7,000", True)], "question string, document string, page int, value string, answerable boolean")

    def judge(asked, said, given):
        if "equity" in asked[0]:
            raise RuntimeError("busy")
        return [f'{{"faithfulness": "0.5", "relevance": {len(g) % 2}, "rationale": "{s[:7]}"}}' for s, g in zip(said, given, strict=True)]

    rows = answering.evaluated(questions, contexts, answers, facts, lambda *a: [x for k in range(len(a[0])) for x in judge(*([c[k]] for c in a))])
    got = {r.question: (r.faithfulness, r.relevance, r.judge_error, r.answer_correct) for r in rows.collect()}
    assert got["1"][0] in (0.5, 0.0) and {r[3] for r in got.values()} == {True}
    assert got["2"] == (0.0, 0.0, "RuntimeError: busy", True)


def test_pages_and_chunks_round_trip_with_broken_lines(spark, tmp_path):
    pages = [("d1", "a.pdf", 1, "Balance Sheets (in thousands)\nA long enough line of prose that a chunk keeps whole.", [[["Revenue", "5"], ["Costs", None]]]), ("d1", "a.pdf", 2, "", []), ("d2", "b.pdf", 1, "Other words that make a chunk of their own, at last.", [])]
    pages = spark.createDataFrame(pages, "deal string, document string, page int, text string, tables array<array<array<string>>>")
    made, path = records.page_records(pages), str(tmp_path / "pages")
    records.write(made, path)
    lines = ['{"document": "a.pdf", "page"', '{"document": "a.pdf", "page": "one", "method": "digital", "scale_factor": 1}', '{"page": 3, "method": "digital", "scale_factor": 1}', '{"document": "a.pdf", "page": 0, "method": "ocr", "scale_factor": 1}',
             '{"document": "a.pdf", "page": 1, "method": "fax", "scale_factor": 1}', '{"document": "a.pdf", "page": 1, "method": "digital", "mean_word_confidence": 9.0, "scale_factor": 1}', '{"document": "a.pdf", "page": 1, "method": "ocr", "scale_factor": 10}']
    spark.createDataFrame([("d1", x) for x in lines], "deal string, value string").coalesce(1).write.mode("append").partitionBy("deal").text(path)
    good, bad = records.read(spark, path, records.PAGE, records.page_rules())
    assert sorted(map(str, good.select(made.columns).collect())) == sorted(map(str, made.collect()))
    reasons = ["no JSON", "wrong type", "no document", "page below 1", "unknown method", "confidence of a digital page", "unknown scale"]
    assert sorted(r.reason for r in bad.collect()) == sorted(reasons) and {r.line for r in bad.collect() if r.reason in reasons[:2]} == set(lines[:2])
    some, none = records.read(spark, path, records.PAGE, records.page_rules(), deals=["d2"])
    assert some.count() == 1 and none.count() == 0
    assert "PartitionFilters: [" in (plan := some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) and "deal" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = storage.written(chunking.chunks(pages, chunking.profile(pages, spark.createDataFrame([], "document string, kind string, status string, trust string"))).withColumn("chunker_version", F.lit("1")), "chunks")
    whole = found.select("deal", *records.T._parse_datatype_string(records.CHUNK).names)
    records.write(whole, str(tmp_path / "chunks"))
    back, lost = records.read(spark, str(tmp_path / "chunks"), records.CHUNK, records.chunk_rules())
    assert lost.count() == 0 and sorted(map(str, back.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
