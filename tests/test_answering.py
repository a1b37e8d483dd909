"""Chunks to answers, checks of answers, calculation log, reconstruction and review rules."""

import pytest
from pyspark.sql import functions as F

from tallyvane.functions import text as X
from tallyvane.operators import answering, chunking, evaluate, memo, operations, search, statements

PAGES = "deal string, document string, page int, text string, tables array<array<array<string>>>, method string, mean_word_confidence double, table_sources array<string>"


@pytest.fixture(scope="module")
def chunks(spark):
    table = [["Customer detail", "Owed"], ["Acme", "1,250"], ["Bolt", "3,400"]]
    text = "Statements of Income\r\n\tAmounts in thousands \x0c\nRevenue for the year was 52,037 in all markets together\nCustomer detail\nacme   1,250\nLong remarks about the customers follow here, for what they are worth."
    rows = [
        ("d", "a.pdf", 1, text, [table], "ocr", 91.5, ["grid"]),
        ("d", "b.pdf", 1, "DRAFT\nCollateral\nThe warehouse in Ghent secures the loan of the bank entirely.", [], "digital", None, []),
        ("d", "c.pdf", 2, None, [], "digital", None, None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    files = spark.createDataFrame([("a.pdf", "financial_statements", "final", "bank")], "document string, kind string, status string, trust string")
    return chunking.chunks(pages, chunking.profile(pages, files)).cache()


def test_chunks_carry_their_page(chunks):
    got = {(r.document, r.chunk_type): r for r in chunks.collect()}
    assert set(got) == {("a.pdf", "table"), ("a.pdf", "prose"), ("b.pdf", "prose")}
    table, prose, other = got["a.pdf", "table"], got["a.pdf", "prose"], got["b.pdf", "prose"]
    assert (table.scale_factor, table.section, table.table_source, table.extraction_method, table.mean_word_confidence) == (1000, "Customer detail", "grid", "ocr", 91.5)
    assert "thousands" in table.scale_evidence
    assert prose.section == "Statements of Income"
    assert prose.text.split("\n")[:2] == ["Statements of Income", "Amounts in thousands"]
    assert "acme" not in prose.text
    assert table.context_header == "a.pdf | page 1 | financial statements | Customer detail | figures in units of 1,000"
    assert (other.status, other.section, other.context_header) == ("draft", None, "b.pdf | page 1 | unknown | DRAFT")
    assert table.embedding_text == f"{table.context_header}\n{table.text}"


def test_sections_follow_offsets(spark):
    pages = spark.createDataFrame([("d", "a", 1, "x\r\nBalance Sheets\r\ny")], "deal string, document string, page int, text string")
    assert [(r.offset, r.line, r.section) for r in chunking.sections(pages).orderBy("place").collect()] == [(0, "x", None), (3, "Balance Sheets", "Balance Sheets"), (19, "y", "Balance Sheets")]


def test_answers_are_retrieved_and_checked(spark, chunks):
    asked = spark.createDataFrame([("q1", "d", "What was the revenue for the year?"), ("q2", "d", "Who painted the ceiling?"), ("q3", "d", "What secures the loan of the bank?")], "question string, deal string, text string")
    contexts = answering.retrieved(chunks, asked).cache()
    assert {r.question for r in contexts.collect()} == {"q1", "q2", "q3"}
    answers = answering.answered(asked, contexts).cache()
    got = {r.question: r for r in answers.collect()}
    assert got["q1"].text == "Revenue for the year was 52,037 in all markets together [a.pdf#p1]"
    assert got["q2"].refused and got["q2"].text == answering.REFUSAL
    facts = spark.createDataFrame([("q1", "a.pdf", 1, "52,037", True), ("q2", None, None, None, False), ("q3", "a.pdf", 1, "warehouse", True)], "question string, document string, page int, value string, answerable boolean")
    rows = {r.question: r for r in answering.evaluated(asked, contexts, answers, facts).collect()}
    assert (rows["q1"].citation_correct, rows["q1"].answer_correct, rows["q1"].refusal_correct, rows["q1"].grounding_rate) == (True, True, None, 1.0)
    assert (rows["q2"].citation_correct, rows["q2"].refusal_correct, rows["q2"].faithfulness) == (True, True, 1.0)
    assert (rows["q3"].citation_correct, rows["q3"].answer_correct) == (False, True)
    report = evaluate.report(answering.evaluated(asked, contexts, answers, facts)).first()
    assert (report.n, report.refusal_accuracy, report.over_refusal_rate, report.hallucinated_figures) == (3, 1.0, 0.0, 0)
    shown = {r.question: r.shown for r in answering.shown(contexts).collect()}
    assert "[a.pdf#p1] " in shown["q1"]
    assert "NOTE: figures on this page are stated in units of 1,000." in shown["q1"]
    assert "marked DRAFT" in shown["q3"]


def test_replies_and_wrappers(spark):
    replies = ['```json\n{"faithfulness": 0.5, "relevance": 1, "rationale": "so"}\n```', "none", "{broken", None]
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(X.judgement("r").alias("j"), X.untrusted("r").alias("u")).collect()
    assert [(r.j.faithfulness, r.j.relevance) for r in rows] == [(0.5, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert rows[1].u == "<untrusted_document>\nnone\n</untrusted_document>"


@pytest.mark.parametrize(
    ("figure", "value", "kind", "expected"),
    [
        ("1,000,000", 1_000_000.0, "USD", False),  # one digit proves nothing
        ("500", 500.0, "USD", False),
        ("-79.2%", -79.2, "percent", True),
        ("79.2%", -79.2, "percent", False),
        ("0", 0.0, "x", True),
        ("0.00x", 0.5, "x", False),
        ("3.95x", 3.9552, "x", True),
        ("3.96x", 3.9552, "x", True),
        ("$21.3", 21_308_027.0, "USD", True),
        ("4.97x", 4.97, "USD", False),
    ],
)
def test_printed_figures(spark, figure, value, kind, expected):
    row = spark.createDataFrame([(figure, value, kind)], "f string, v double, k string")
    assert row.select(statements.printed_as("f", "v", "k").alias("x")).first().x is expected


def test_calculation_log(spark):
    figures = [("d", k, v, "a.pdf", 3) for k, v in (("ebitda", 1000.0), ("revenue", 4000.0), ("current_portion_ltd", 500.0), ("ltd_noncurrent", 1500.0))]
    log = {r.name: r for r in statements.calculation_log(spark.createDataFrame(figures, "deal string, key string, value double, document string, page int")).collect()}
    assert set(log) == {"total debt", "leverage", "EBITDA margin"}
    assert log["leverage"].forms == ["2.00x", "2.0x", "2.00", "2.0"]
    assert log["total debt"].forms == ["$2,000", "2,000", "2000"]
    assert log["EBITDA margin"].forms == ["25.0%", "25.0", "25", "25%"]
    assert log["leverage"].audit == "leverage = 2.00x from current_portion_ltd 500 [a.pdf#p3]; ltd_noncurrent 1,500 [a.pdf#p3]; ebitda 1,000 [a.pdf#p3]"
    kinds = spark.createDataFrame([("Gross margin",), ("Debt / EBITDA",), ("Revenue",)], "l string").select(statements.kind_of("l").alias("k")).collect()
    assert [r.k for r in kinds] == ["percent", "x", "USD"]


def test_review_rules(spark):
    decisions = spark.createDataFrame([("a", True, False, "accounting identity broken", None, None), ("b", True, False, "no recommendation", None, None)], "deal string, blocked boolean, conservative boolean, reason string, stated string, required string")
    checks = spark.createDataFrame([("b", "issue", "21.3", "debt + request"), ("b", "issue", "9,999", None)], "deal string, standing string, figure string, derivation string")
    findings = spark.createDataFrame([("a", "assets")], "deal string, identity string")
    none = spark.createDataFrame([], "deal string, document string, kind string")
    got = {(r.deal, r.kind) for r in memo.review_items(decisions, checks, findings, none).collect()}
    assert got == {("a", "accounting_inconsistency"), ("b", "blocked_memo"), ("b", "reconstruction"), ("b", "low_confidence_extraction")}
    state = spark.createDataFrame([("i", "a", "blocked_memo", "rejected", True), ("j", "b", "blocked_memo", "pending", True)], "item_id string, deal string, kind string, decision string, blocking boolean")
    assert {r.deal: r.releasable for r in operations.releasable(state).collect()} == {"a": True, "b": False}
    assert {(r.kind, r.decision): r.n for r in operations.queue_counts(state).collect()} == {("blocked_memo", "rejected"): 1, ("blocked_memo", "pending"): 1}


def test_search_has_no_cartesian_product(spark, chunks):
    asked = spark.createDataFrame([("q", "d", "revenue")], "question string, deal string, text string")
    docs = chunks.select(F.col("deal").alias("part"), F.col("chunk_id").alias("doc"), "text", "status", F.array(F.lit(1.0)).alias("vector"))
    asked = asked.select(F.col("question").alias("query"), F.col("deal").alias("part"), "text", F.array(F.lit(1.0)).alias("vector"))
    plan = search.hybrid(search.build(docs), docs, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
