"""Structure-aware chunking of pages, with provenance.

Pages are rows (deal, document, page, text, tables: arrays of rows of cells). Lines and table rows pack greedily, in order,
by SQL folds over a page's own array; a page stays one row until its chunks are numbered, so that its text is shuffled once, to meet
what is known of its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import text as X

# Fixed values of the packing rules.
TARGET, MOST, CARRY, LEAST_PROSE = 900, 1400, 150, 40

#: Where Python's line splitting ends a line.
BREAK = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
BREAKS = rf"\r\n|[{BREAK}]"
OTHER_BREAKS = f"[{BREAK.replace(chr(92) + 'n', '')}]"
#: What names a page.
KEY = ("deal", "document", "page")


def pieces(text):
    """A text's lines with what ends them. Most texts have line feeds alone, for which cutting is much faster than a pattern."""
    every = F.regexp_extract_all(text, F.lit(f"[^{BREAK}]*(?:\\r\\n|[{BREAK}])|[^{BREAK}]+"), F.lit(0))

    def ended(lines):
        n = F.size(lines)
        return F.concat(F.transform(F.slice(lines, 1, n - 1), lambda x: F.concat(x, F.lit("\n"))), F.filter(F.slice(lines, n, 1), lambda x: x != ""))

    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(OTHER_BREAKS), every).otherwise(X.let(F.split(text, "\n"), ended))


def headings(text):
    """An array of a text's headings (offset, heading), in order."""
    none = F.array().cast("array<struct<offset:int,heading:string>>")

    def step(s, p):
        more = X.let(X.heading(p), lambda h: F.when(h.isNotNull(), F.concat(s["found"], F.array(F.struct(s["at"].alias("offset"), h.alias("heading"))))).otherwise(s["found"]))
        return F.struct((s["at"] + F.length(p)).alias("at"), more.alias("found"))

    found = F.aggregate(pieces(text), F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.coalesce(F.when(X.mentions(text, [n.lower() for n in X.HEADINGS]), found), none)


def sections(pages: DataFrame) -> DataFrame:
    """deal, document, page, place, offset (in characters of the page), line (without white space at its ends), heading, if it is one,
    and section: the latest heading at or before it."""
    rows = pages.select(*KEY, F.posexplode(pieces("text")).alias("place", "piece"))
    order = Window.partitionBy(*KEY).orderBy("place")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumns({"offset": before, "line": X.strip("piece")}).withColumn("heading", X.heading("line"))
    return rows.withColumn("section", F.last("heading", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("piece")


def packed_lines(lines):
    """An array of lines (n: characters with what ends the line, line, kept: whether it counts) packed to chunks (text, start: offset of the first
    line): up to TARGET characters each, whole trailing lines of up to CARRY characters repeated at the head of the next chunk. A longer line is a
    chunk of its own."""
    fields = ("at", "done", "open", "size", "start")
    state = lambda **new: F.struct(*(new[c].alias(c) for c in fields))
    start = state(at=F.lit(0), done=F.array().cast("array<struct<text:string,start:int>>"), open=F.array().cast("array<string>"), size=F.lit(0), start=F.lit(0))
    # Trailing whole lines that together stay within CARRY.
    carried = lambda open_: F.aggregate(
        F.reverse(open_),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"), F.lit(False).alias("stop")),
        lambda b, y: F.when(b["stop"] | (b["size"] + F.length(y) > CARRY), F.struct(b["kept"].alias("kept"), b["size"].alias("size"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.concat(F.array(y), b["kept"]).alias("kept"), (b["size"] + F.length(y) + 1).alias("size"), F.lit(False).alias("stop"))
        ),
    )

    def step(s, x):
        size, at = F.length(x["line"]) + 1, s["at"] + x["n"]
        chunk = F.struct(F.array_join(s["open"], "\n").alias("text"), s["start"].alias("start"))
        closed = X.let(carried(s["open"]), lambda back: state(at=at, done=F.concat(s["done"], F.array(chunk)), open=F.concat(back["kept"], F.array(x["line"])), size=back["size"] + size, start=s["at"] - back["size"]))
        first = F.when(s["size"] > 0, s["start"]).otherwise(s["at"])
        more = state(at=at, done=s["done"], open=F.concat(s["open"], F.array(x["line"])), size=s["size"] + size, start=first)
        over = state(at=at, **{c: s[c] for c in fields[1:]})
        return F.when(~x["kept"], over).when((s["size"] > 0) & (s["size"] + size > TARGET), closed).otherwise(more)

    def finish(s):
        last = F.struct(F.array_join(s["open"], "\n").alias("text"), s["start"].alias("start"))
        return F.when(s["size"] > 0, F.concat(s["done"], F.array(last))).otherwise(s["done"])

    # Most pages are one chunk, which needs no fold: their lines together, from the first of them that isn't empty.
    kept = lambda ls: F.transform(F.filter(ls, lambda x: x["kept"]), lambda x: x["line"])
    size = lambda ls: F.aggregate(ls, F.lit(0), lambda s, x: s + F.when(x["kept"], F.length(x["line"]) + 1).otherwise(0))
    first = lambda ls: F.aggregate(ls, F.struct(F.lit(0).alias("at"), F.lit(False).alias("end")), lambda s, x: F.when(s["end"] | x["kept"], F.struct(s["at"].alias("at"), F.lit(True).alias("end"))).otherwise(F.struct((s["at"] + x["n"]).alias("at"), F.lit(False).alias("end"))), lambda s: s["at"])
    one = lambda ls: F.when(F.exists(ls, lambda x: x["kept"]), F.array(F.struct(F.array_join(kept(ls), "\n").alias("text"), first(ls).alias("start")))).otherwise(F.array().cast("array<struct<text:string,start:int>>"))
    return X.let(lines, lambda ls: F.when(size(ls) <= TARGET, one(ls)).otherwise(F.aggregate(ls, start, step, finish)))


def packed_rows(rows):
    """A table's rows (arrays of cells) packed to texts of up to MOST characters; the header leads every one, and no row is
    cut. A table of a header alone is one text."""
    lines = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: X.strip(F.coalesce(c, F.lit("")))), " | "))
    head, body = F.element_at(lines, 1), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    start = F.struct(F.array().cast("array<string>").alias("done"), head.alias("open"), F.lit(0).alias("n"))

    def step(s, line):
        full = (s["n"] > 0) & (F.length(s["open"]) + 1 + F.length(line) > MOST)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), F.concat_ws("\n", head, line).alias("open"), F.lit(1).alias("n"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat_ws("\n", s["open"], line).alias("open"), (s["n"] + 1).alias("n"))
        )

    packed = F.aggregate(body, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))
    whole = F.array_join(lines, "\n")
    return F.when(F.size(rows) == 0, F.array().cast("array<string>")).when(F.length(whole) <= MOST, F.array(whole)).otherwise(packed)


def profile(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Status and authority of every document: its file's status, lowered by what the text of all its pages says.

    files: document, kind, status, trust; unknown files are final and borrower_prepared."""
    says = lambda words, patterns: F.max(X.mentions("text", words) & X.any_like("text", patterns))
    marks = pages.groupBy("deal", "document").agg(says(X.DRAFT_WORDS, X.DRAFT).alias("draft"), says(X.SUPERSEDED_WORDS, X.SUPERSEDED).alias("old"))
    known = marks.join(files, "document", "left").fillna({"kind": "unknown", "status": "final", "trust": "borrower_prepared"})
    status = F.when((F.col("status") == "draft") | F.col("draft"), "draft").when((F.col("status") == "final") & F.col("old"), "superseded").otherwise(F.col("status"))
    return known.select("deal", "document", "kind", status.alias("status"), "trust").withColumn("authority", X.authority("status"))


def chunks(pages: DataFrame, profiles: DataFrame, barred: bool = False) -> DataFrame:
    """All chunks of all pages: tables first, then prose lines that aren't rows of the page's tables. barred: pages print rows with bars between
    their cells, so that a line without is prose even if its words are a row's.

    Prose of fewer than LEAST_PROSE characters is dropped, tables never. Chunks of a page are numbered without gaps. Scale and its
    evidence are the page's, as a table seldom says in what its figures are stated; a chunk's section is the latest heading at or
    before its first line, a table's at or before its first cell. method, mean_word_confidence and table_sources (one for each table) are
    handed on where the pages have them."""
    given = {"method": "string", "mean_word_confidence": "double", "table_sources": "array<string>"}
    pages = pages.withColumns({c: F.lit(None).cast(t) for c, t in given.items() if c not in pages.columns})
    bare_row = lambda cells: X.normal_row(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit(" "))))
    none = F.array().cast("array<string>")
    # A page may print a table's row with bars between its cells, or by white space alone.
    printed = lambda line: F.contains(line, F.lit(" | ")) if barred else F.lit(True)
    # Most rows are printed as they are, with single blanks; only other lines are put in their normal form.
    is_row = lambda rows, line: printed(line) & (F.array_contains(rows["said"], line) | F.array_contains(rows["bare"], bare_row(F.array(line))))
    counts = lambda rows, line: F.when(line == "", False).when(F.size(rows["bare"]) == 0, True).otherwise(~is_row(rows, line))
    split = F.transform(F.coalesce(pieces("text"), none), lambda p: F.struct(F.length(p).alias("n"), X.strip(p).alias("line")))
    marked = lambda rows: F.transform(split, lambda x: F.struct(x["n"].alias("n"), x["line"].alias("line"), counts(rows, x["line"]).alias("kept")))
    of_rows = lambda form: F.coalesce(F.transform(F.flatten("tables"), form), none)
    lines = X.let(F.struct(of_rows(lambda r: F.array_join(r, " ")).alias("said"), of_rows(bare_row).alias("bare")), marked)
    section = lambda known, at: F.try_element_at(F.filter(known, lambda h: h["offset"] <= at), F.lit(-1))["heading"]
    fields = lambda section, source, kind, text: F.struct(section.alias("section"), source.alias("table_source"), F.lit(kind).alias("chunk_type"), text.alias("text"))

    def of_table(known, rows, a):
        cell = F.coalesce(F.try_element_at(F.filter(F.try_element_at(rows, F.lit(1)), lambda c: X.strip(c) != ""), F.lit(1)), F.lit(""))
        at = F.greatest(F.when(cell != "", F.position(cell, F.col("text")) - 1).otherwise(0), F.lit(0))
        return X.let(section(known, at), lambda s: F.transform(packed_rows(rows), lambda body: fields(s, F.get("table_sources", a), "table", body)))

    def of_page(known):
        of_tables = F.coalesce(F.flatten(F.transform("tables", lambda rows, a: of_table(known, rows, a))), F.array())
        prose = F.transform(packed_lines(lines), lambda c: fields(section(known, c["start"]), F.lit(None).cast("string"), "prose", c["text"]))
        return F.concat(F.filter(of_tables, lambda c: X.strip(c["text"]) != ""), F.filter(prose, lambda c: F.length(X.strip(c["text"])) >= LEAST_PROSE))

    provenance = ["method", "mean_word_confidence", "scale_factor", "scale_evidence"]
    whole = pages.withColumns({"scale_factor": X.scale("text"), "scale_evidence": X.scale_evidence("text")}).select(*KEY, *provenance, X.let(headings("text"), of_page).alias("made"))
    # Null-safe, as documents without a name have chunks, too.
    known = profiles.select(F.col("deal").alias("p_deal"), F.col("document").alias("p_document"), *(c for c in profiles.columns if c not in KEY))
    out = whole.join(known, F.col("deal").eqNullSafe(F.col("p_deal")) & F.col("document").eqNullSafe(F.col("p_document")))
    # Outer, as Spark filters by the array beforehand otherwise and makes it three times.
    out = out.select(*KEY, *provenance, *(c for c in profiles.columns if c not in KEY), F.posexplode_outer("made").alias("chunk_index", "c")).filter("c IS NOT NULL").select("*", "c.*").drop("c")
    out = out.withColumnRenamed("method", "extraction_method")
    name = F.concat_ws("::", "deal", "document", F.format_string("p%03d", F.col("page").cast("int")), F.format_string("c%03d", "chunk_index"))
    head = F.concat_ws(
        " | ",
        "document",
        F.concat(F.lit("page "), F.col("page").cast("string")),
        F.regexp_replace("kind", "_", " "),
        "section",
        F.when(F.col("status") != "final", F.upper("status")),
        F.when(F.col("scale_factor") != 1, F.concat(F.lit("figures in units of "), F.format_number("scale_factor", 0))),
    )
    out = out.withColumns({"chunk_id": name, "context_header": head, "char_count": F.length("text"), "word_count": F.size(F.split(X.strip("text"), r"\s+"))})
    return out.withColumn("embedding_text", F.concat_ws("\n", "context_header", "text"))


def chunk_summary(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Deals, pages, chunks by type, status and scale, their sizes, and how many pages have none."""
    bare = pages.join(found, list(KEY), "left_anti").agg(F.count("*").alias("pages_without_chunks"))
    whole = pages.agg(F.count_distinct("deal").alias("deals"), F.count("*").alias("pages"))
    sizes = found.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("chunk_type") == "prose").alias("prose_chunks"),
        F.count_if(F.col("chunk_type") == "table").alias("table_chunks"),
        F.count_if(F.col("status") == "draft").alias("draft_chunks"),
        F.count_if(F.col("status") == "superseded").alias("superseded_chunks"),
        F.count_if(F.col("scale_factor") != 1).alias("scaled_chunks"),
        F.avg("char_count").alias("mean_chars"),
        F.max("char_count").alias("max_chars"),
    )
    return whole.crossJoin(sizes).crossJoin(bare)  # one row each
