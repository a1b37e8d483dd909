"""Retrieve, then answer: chunks indexed per deal, the contexts of hits, cited answers, and their evaluation against facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions import text as X
from tallyvane.operators import evaluate, models, search
from tallyvane.sources import storage

REFUSAL = "The documents do not contain the answer."


def retrieved(chunks: DataFrame, questions: DataFrame, k: int = 5, options: search.Options = search.Options(dense=False)) -> DataFrame:  # noqa: B008
    """Contexts of every question (question, deal, text): the k best chunks of its deal, found by header and text, with their rank.

    chunks: of chunking.chunks(), with vectors or without; questions may have one, too. Without vectors only words are searched. Chunks
    and contexts are written to the shared folder, as both are read several times."""
    chunks = storage.written(chunks, "chunks")
    docs = chunks.select(F.col("deal").alias("part"), F.col("chunk_id").alias("doc"), F.col("embedding_text").alias("text"), "status", _vector(chunks))
    asked = questions.select(F.col("question").alias("query"), F.col("deal").alias("part"), "text", _vector(questions))
    hits = search.hybrid(search.build(docs), docs, asked, k, options)
    own = chunks.select(F.col("chunk_id").alias("doc"), "document", "page", "text", "context_header", "status", "scale_factor")
    found = hits.select(F.col("query").alias("question"), "rank", "doc").join(own, "doc").withColumnRenamed("doc", "chunk_id")
    return storage.written(found, "contexts")


def _vector(rows: DataFrame):
    return F.col("vector") if "vector" in rows.columns else F.lit(None).cast("array<double>").alias("vector")


def shown(contexts: DataFrame) -> DataFrame:
    """question and its contexts as one text, each with its citation mark, header and what limits it, in order of rank."""
    notes = F.concat(
        F.when(F.col("scale_factor") != 1, F.concat(F.lit("\nNOTE: figures on this page are stated in units of "), F.format_number("scale_factor", 0), F.lit("."))).otherwise(""),
        F.when(F.col("status") != "final", F.concat(F.lit("\nNOTE: this document is marked "), F.upper("status"), F.lit(" and is not authoritative."))).otherwise(""),
    )
    block = F.concat(F.lit("["), "document", F.lit("#p"), F.col("page").cast("string"), F.lit("] "), F.coalesce("context_header", F.lit("")), notes, F.lit("\n"), "text")
    ordered = contexts.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))  # k of a question
    return ordered.select("question", F.array_join("blocks.block", "\n\n---\n\n").alias("shown"))


def answered(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """question, text and refused: the best line of the contexts with its citation, or a refusal."""
    found = evaluate.extractive_answers(questions, contexts)
    said = F.concat("line", F.lit(" ["), "document", F.lit("#p"), F.col("page").cast("string"), F.lit("]"))
    return found.select("question", F.when(F.col("refused"), REFUSAL).otherwise(said).alias("text"), "refused")


def checked(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers (question, text, refused) against facts (question, document, page: where the answer is, null if nowhere; value: as
    printed, null if any will do; answerable): citation_correct, answer_correct, and refusal_correct, null where a refusal isn't right."""
    cited = X.citations("text")
    rows = answers.join(facts, "question")
    there = F.array_contains(cited, F.struct(F.col("document").alias("document"), F.col("page").cast("int").alias("page")))
    stated = F.when(F.col("value").rlike(r"^[0-9$]"), X.figure_in("value", "text")).otherwise(F.contains(F.lower("text"), F.lower("value")))
    return rows.select(
        "question",
        F.when(F.col("document").isNull(), F.size(cited) == 0).otherwise(there).alias("citation_correct"),
        F.coalesce(stated, F.lit(True)).alias("answer_correct"),
        F.when(~F.col("answerable"), F.col("refused") & (F.size(cited) == 0)).alias("refusal_correct"),
    )


def evaluated(questions: DataFrame, contexts: DataFrame, answers: DataFrame, facts: DataFrame, judge: Callable | None = None) -> DataFrame:
    """One row per question with all that evaluate.report() sums up: checks, grounding, invented citations and the overlap judgement, or that
    of a judge (models.judged()), whose replies that can't be read, or had, count as 0; judge_error says why there is none."""
    said = answers.select(F.col("question").alias("answer"), "text")
    pages = contexts.select(F.col("question").alias("answer"), "document", "page", "text")
    rates = evaluate.grounding_rates(said, evaluate.grounding(said, pages)).select(F.col("answer").alias("question"), F.col("rate").alias("grounding_rate"), "hallucinated")
    dropped = evaluate.checked_citations(said, pages).groupBy(F.col("answer").alias("question")).agg(F.count_if(~F.col("kept")).alias("invented"))
    given = contexts.groupBy("question").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("given"))  # k of a question
    rows = answers.withColumnRenamed("text", "said").join(questions.select("question", F.col("text").alias("asked")), "question").join(given, "question", "left")
    rows = rows.withColumn("given", F.coalesce("given", F.lit("")))
    if judge:
        rows = models.judged(rows, judge).withColumn("judged", X.judgement("reply"))
    else:
        rows = rows.withColumn("judged", evaluate.overlap_judgement(F.col("asked"), F.col("said"), F.col("given"), "refused"))
    more = ["judge_error"] if judge else []
    rows = rows.select("question", "refused", "judged.faithfulness", "judged.relevance", *more).join(checked(answers, facts), "question").join(rates, "question")
    return rows.join(dropped, "question", "left").fillna(0, ["invented"])
