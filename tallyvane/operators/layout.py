"""Page layout: words to lines, cells, tables; page routing; summaries.

Words are rows (page, ord, text, left, top, width, height, confidence, line). Runs and gaps are window sums, so a page of any
number of words is a sort, not a loop; only lines without an engine's line number need an ordered fold per page. Where a line's words are at
hand, in order, line_cells() cuts them where they are, and row_tables() goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.functions import text as X

# Fixed values of the layout rules.
TEXT_LAYER = 40
OVERLAP = 0.4
COLUMN_GAP = 0.035
LEAST_ROWS = 3
LEAST_WORDS, LEAST_SCORE = 8, 20.0


def has_text_layer(text):
    return F.length(X.strip(F.coalesce(text, F.lit("")))) >= TEXT_LAYER


def clean_cell(cell):
    """Single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))


def overlap(a_top, a_height, b_top, b_height):
    """Shared height of two boxes as a share of the shorter one's."""
    shared = F.least(a_top + a_height, b_top + b_height) - F.greatest(a_top, b_top)
    short = F.least(a_height, b_height)
    return F.when((short <= 0) | (shared <= 0), 0.0).otherwise(shared / short)


def lines(words: DataFrame) -> DataFrame:
    """Words with the number of their line. An engine's line numbers hold where a page's words all have one; otherwise words,
    from left to right, join the line whose last word they overlap most, if by more than OVERLAP."""
    import pandas as pd

    known = F.min(F.col("line").isNotNull()).over(Window.partitionBy("page"))
    marked = words.withColumn("known", known)
    given = marked.filter("known").withColumn("row", F.dense_rank().over(Window.partitionBy("page").orderBy("line")) - 1)

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        ends: list[tuple[float, float]] = []
        found = []
        rows = rows.sort_values(["left", "ord"], kind="stable")
        for top, height in zip(rows["top"], rows["height"], strict=True):
            best, line = OVERLAP, -1
            for k, (t, h) in enumerate(ends):
                low = min(h, height)
                share = (min(t + h, top + height) - max(t, top)) / low if low > 0 else 0.0
                if share > best:
                    best, line = share, k
            if line < 0:
                line = len(ends)
                ends.append((top, height))
            else:
                ends[line] = (top, height)
            found.append(line)
        rows["row"] = found
        order = rows.groupby("row")["top"].min().rank(method="first").astype(int) - 1
        rows["row"] = rows["row"].map(order)
        return rows

    schema = T.StructType([*marked.schema.fields, T.StructField("row", T.IntegerType())])
    folded = marked.filter("NOT known").groupBy("page").applyInPandas(greedy, schema)
    return given.unionByName(folded).drop("known")


def text_of(words: DataFrame) -> DataFrame:
    """page and text: words of a line by a space, lines by a line feed."""
    rows = words.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("left", "ord", "text"))).alias("w"))
    rows = rows.select("page", "row", F.array_join(F.col("w.text"), " ").alias("line"))
    whole = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l"))
    return whole.select("page", F.array_join(F.col("l.line"), "\n").alias("text"))


def cells(words: DataFrame, page_width) -> DataFrame:
    """page, row, cell, text: words of a line, split where the gap to the one before exceeds a share of the page's width."""
    order = Window.partitionBy("page", "row").orderBy("left", "ord")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order)
    starts = F.coalesce((gap > COLUMN_GAP * page_width).cast("int"), F.lit(0))
    marked = words.withColumn("starts", starts).withColumn("cell", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = marked.groupBy("page", "row", "cell").agg(F.array_sort(F.collect_list(F.struct("left", "ord", "text"))).alias("w"))
    return grouped.select("page", "row", F.col("cell").cast("int").alias("cell"), F.array_join(F.col("w.text"), " ").alias("text"))


def line_cells(words, page_width):
    """The cells (texts) of a line whose words are an array (left, width, text) from left to right, as cells() makes them: nothing is sorted or shuffled."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(None).cast("long").alias("end"))

    def step(s, w):
        end = (w["left"] + w["width"]).cast("long")
        parted = F.coalesce(w["left"] - s["end"] > COLUMN_GAP * page_width, F.lit(False))
        done = F.concat(s["done"], F.array(F.array_join(s["open"], " ")))
        return F.when(parted, F.struct(done.alias("done"), F.array(w["text"]).alias("open"), end.alias("end"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(w["text"])).alias("open"), end.alias("end"))
        )

    finish = lambda s: F.when(s["end"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.array_join(s["open"], " "))))
    return F.aggregate(words, start, step, finish)


def tables(cell_rows: DataFrame) -> DataFrame:
    """page, table, row, cells: longest runs of consecutive lines of two cells or more that are at least LEAST_ROWS long."""
    rows = cell_rows.groupBy("page", "row").agg(F.array_sort(F.collect_list(F.struct("cell", "text"))).alias("c"))
    return row_tables(rows.select("page", "row", F.col("c.text").alias("cells")))


def row_tables(rows: DataFrame) -> DataFrame:
    """tables() of lines whose cells are an array: page, row (consecutive lines of a page have consecutive numbers), cells. Lines of one cell only
    part others, so that they needn't be there: only lines that may be a table's are shuffled and sorted."""
    order = Window.partitionBy("page").orderBy("row")
    # Consecutive numbers less their places are the same throughout a run.
    marked = rows.filter(F.size("cells") >= 2).withColumn("run", F.col("row") - F.row_number().over(order))
    whole = marked.withColumn("n", F.count("*").over(Window.partitionBy("page", "run"))).filter(F.col("n") >= LEAST_ROWS)
    return whole.select("page", (F.dense_rank().over(Window.partitionBy("page").orderBy("run")) - 1).alias("table"), "row", "cells")


def table_shape(table_rows: DataFrame) -> DataFrame:
    """page, table, n_rows, n_cols (of the widest row) and n_cells that aren't blank."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    return table_rows.groupBy("page", "table").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), F.sum(filled).alias("n_cells"))


def orientation(words: DataFrame, page_width) -> DataFrame:
    """page and score: mean confidence times the median line span as a share of the page's width; 0 for few words."""
    spans = words.groupBy("page", "row").agg((F.max(F.col("left") + F.col("width")) - F.min("left")).alias("span"))
    median = spans.groupBy("page").agg(F.median("span").alias("span"))
    found = words.groupBy("page").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).join(median, "page")
    score = F.col("confidence") * F.col("span") / page_width
    return found.select("page", F.when((F.col("n") < LEAST_WORDS) | (F.lit(page_width) <= 0), 0.0).otherwise(score).alias("score"))


def best_rotation(candidates: DataFrame) -> DataFrame:
    """Of the rows (page, rotation, proposed, score) the one to keep: the better of upright and the proposal, or, if that is
    poor, the best of all."""
    first = F.when(F.col("proposed") | (F.col("rotation") == 0), F.col("score"))
    whole = candidates.withColumn("first", F.max(first).over(Window.partitionBy("page")))
    allowed = whole.filter((F.col("first") < LEAST_SCORE) | F.col("proposed") | (F.col("rotation") == 0))
    best = Window.partitionBy("page").orderBy(F.desc("score"), "rotation")
    return allowed.withColumn("r", F.row_number().over(best)).filter("r = 1").select("page", "rotation", "score")


def summary(pages: DataFrame) -> DataFrame:
    """Counts of pages by method, pages without text, tables, and mean OCR confidence to two places."""
    return pages.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("method") == "digital").alias("digital"),
        F.count_if(F.col("method") == "ocr").alias("ocr"),
        F.count_if(F.trim("text") == "").alias("empty"),
        F.sum(F.size("tables")).alias("tables"),
        F.round(F.avg("mean_word_confidence"), 2).alias("mean_confidence"),
    )
