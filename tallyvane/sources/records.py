"""Pages and chunks as typed records: JSON lines, a folder a deal, read back with what doesn't fit kept apart.

Reading never fails on a line and never loses one: lines that are no record of the schema, or break a rule of its kind, come back as they
are with a reason. Deals are folders, so that asking for some reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "array<struct<rows: array<array<string>>, source: string>>"
#: Columns of a page as ingestion leaves it.
PAGE = f"document string, page int, method string, rotation int, text string, word_count int, mean_word_confidence double, tables {TABLES}, scale_factor int, scale_evidence string, extractor_version string"
#: Columns of a chunk with all its provenance.
CHUNK = (
    "chunk_id string, document string, page int, chunk_index int, chunk_type string, text string, context_header string, section string, kind string, status string, authority int, trust string, "
    "extraction_method string, mean_word_confidence double, scale_factor int, scale_evidence string, table_source string, chunker_version string, char_count int, word_count int"
)


def page_rules() -> list[tuple[str, Column]]:
    """What a page has to be, as (reason, condition under which it isn't), the first of which holds."""
    return [
        ("no document", F.coalesce(F.col("document"), F.lit("")) == ""),
        ("page below 1", F.coalesce(F.col("page") < 1, F.lit(True))),
        ("unknown method", ~F.coalesce(F.col("method").isin("digital", "ocr"), F.lit(False))),
        ("confidence of a digital page", (F.col("method") == "digital") & F.col("mean_word_confidence").isNotNull()),
        ("unknown scale", ~F.coalesce(F.col("scale_factor").isin(1, 1000, 1000000), F.lit(False))),
    ]


def chunk_rules() -> list[tuple[str, Column]]:
    return [
        ("no name", F.coalesce(F.col("chunk_id"), F.lit("")) == ""),
        ("no text", F.coalesce(F.trim("text"), F.lit("")) == ""),
        ("unknown type", ~F.coalesce(F.col("chunk_type").isin("prose", "table"), F.lit(False))),
        ("unknown status", ~F.coalesce(F.col("status").isin("final", "superseded", "draft"), F.lit(False))),
    ]


def page_records(pages: DataFrame, method: str = "digital", version: str = "1") -> DataFrame:
    """Pages (deal, document, page, text, tables: arrays of rows) as records of PAGE, their scale read from the text."""
    from tallyvane.functions import text as X

    tables = F.transform("tables", lambda t: F.struct(t.alias("rows"), F.lit("text_layer").alias("source")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    given = {"method": F.lit(method), "rotation": F.lit(0), "mean_word_confidence": F.lit(None).cast("double"), "extractor_version": F.lit(version)}
    out = pages.withColumns({c: e for c, e in given.items() if c not in pages.columns})
    out = out.withColumns({"tables": tables, "word_count": words, "scale_factor": X.scale("text"), "scale_evidence": X.scale_evidence("text")})
    return out.select("deal", *T._parse_datatype_string(PAGE).names)


def write(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records (deal and more) as JSON lines, a folder for each deal."""
    records.write.mode(mode).partitionBy("deal").json(path)


def read(spark: SparkSession, path: str, columns: str, rules: list[tuple[str, Column]], deals: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records that fit (deal and the columns), and lines that don't (deal, line, reason)."""
    fields = T._parse_datatype_string(columns)
    schema = T.StructType([*fields.fields, T.StructField("deal", T.StringType()), T.StructField("_line", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_line").json(path)
    if deals is not None:
        rows = rows.filter(F.col("deal").isin(deals))
    broken = F.when(F.col("_line").isNotNull(), F.when(F.get_json_object("_line", "$").isNull(), "no JSON").otherwise("wrong type"))
    reason = broken
    for name, condition in rules:
        reason = F.coalesce(reason, F.when(condition, name))
    rows = rows.withColumn("reason", reason)
    line = F.coalesce("_line", F.to_json(F.struct(*fields.names)))
    return rows.filter("reason IS NULL").select("deal", *fields.names), rows.filter("reason IS NOT NULL").select("deal", line.alias("line"), "reason")
