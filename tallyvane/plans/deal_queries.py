"""Queries over whole credit packages: facts, retrieval, memos, attacks through retrieval, receivables; with their SQL.

The SQL builds the packages from the same templates, but cuts no pages and runs no operator: chunks are what the templates say, search
is joins over their tokens, and figures are read from the lines that were found.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyvane.functions import text as X
from tallyvane.operators import answering, chunking, evaluate, memo, operations, search, statements
from tallyvane.plans import page_queries
from tallyvane.plans.search_queries import STOP, tokens_sql
from tallyvane.sources import deals, storage

#: Attacks on what searches return: the instructions and their disguises, and rows that a statement might have.
ATTACKS = [a for a in page_queries.ATTACKS if a[1] != "data"] + [
    ("raised_ebitda", "data", "data", "EBITDA | 99,000,000,000"),
    ("lowered_debt", "data", "data", "Long-term debt, net of current portion | 1"),
    ("lowered_interest", "data", "data", "Interest expense | 1"),
    ("raised_capex", "data", "data", "Capital expenditures | 99,000,000,000"),
    ("endless_amount", "data", "data", "EBITDA | " + "9" * 400),
]


def packages(spark, sf_dir):
    """Deals and the chunks of their packages, both written."""
    rows = storage.written(deals.deals(spark, sf_dir), "deals")
    pages = storage.written(deals.pages(rows), "pages")
    return rows, storage.written(chunking.chunks(pages, chunking.profile(pages, deals.files(spark))), "chunks")


def deal_facts(spark, sf_dir):
    """Gold facts of every deal."""
    return deals.facts(deals.deals(spark, sf_dir))


DEAL_FACTS = f"WITH {deals.DEALS_SQL}, {deals.FACTS_SQL} SELECT fact, deal, fact_type, question, answer, answer_text, unit, document, page, answerable, defect FROM facts"


def deal_recall(spark, sf_dir):
    """Recall and reciprocal rank of the page that answers each answerable fact, among the pages of ten hits, by stages and type of fact."""
    rows, chunks = packages(spark, sf_dir)
    facts = storage.written(deals.facts(rows).filter("answerable"), "facts")
    docs = chunks.select(F.col("deal").alias("part"), F.col("chunk_id").alias("doc"), F.col("embedding_text").alias("text"), "status", F.lit(None).cast("array<double>").alias("vector"))
    asked = facts.select(F.col("fact").alias("query"), F.col("deal").alias("part"), F.col("question").alias("text"), F.lit(None).cast("array<double>").alias("vector"))
    index = search.build(docs)
    page = F.concat_ws("#", "document", F.col("page").cast("string")).alias("doc")
    gold = facts.select(F.col("fact").alias("query"), page)
    where = chunks.select(F.col("chunk_id").alias("chunk"), page)
    kinds = facts.select(F.col("fact").alias("query"), "fact_type")
    # Both orders are of the same candidates.
    terms = search.asked_terms(index, asked)
    first = search.first_stages(index, docs, asked, search.Options(dense=False), terms)
    out = None
    for stages, options in (("bm25", search.Options(dense=False, rerank=False, authority=False)), ("full", search.Options(dense=False))):
        hits = search.hybrid(index, docs, asked, 10, options, first=first, asked=terms).withColumnRenamed("doc", "chunk").join(where, "chunk").select("query", "doc", "rank")
        report = evaluate.recall_report(evaluate.gold_ranks(hits, gold).join(kinds, "query"), by=["fact_type"]).withColumn("stages", F.lit(stages))
        out = report if out is None else out.unionByName(report)
    return out.select("stages", "fact_type", "n", *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("recall") or c == "mrr"))


def search_sql(asked: str, k: int, rerank: bool = True, authority: bool = True) -> str:
    """CTEs up to `hit` (deal, q, doc, rank): the k best chunks of a deal for each of its questions; asked: SELECT of q, deal and text."""
    first = "0.65::DOUBLE * x + 0.35::DOUBLE * y" if rerank else "0.65::DOUBLE * y + 0.35::DOUBLE * y"
    weight = "CASE status WHEN 'superseded' THEN 0.82::DOUBLE WHEN 'draft' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END" if authority else "1.0::DOUBLE"
    return f"""tok AS (SELECT id AS doc, token AS term, count(*) AS tf FROM {tokens_sql("SELECT chunk AS id, head || chr(10) || text AS text FROM chunk")} GROUP BY ALL
), len_ AS (SELECT deal, chunk AS doc, status, coalesce(sum(tf), 0) AS length FROM chunk LEFT JOIN tok ON doc = chunk GROUP BY ALL
), part AS (SELECT deal, count(*) AS docs, avg(length) AS mean_length FROM len_ GROUP BY deal
), posting AS (SELECT deal, tok.doc, term, tf, tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length)) AS impact FROM tok JOIN len_ USING (doc) JOIN part USING (deal)
), term_ AS (SELECT deal, term, greatest(1e-6, ln((any_value(docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1)) AS idf FROM posting JOIN part USING (deal) GROUP BY deal, term
), ask AS ({asked}
), word AS (SELECT text, token AS term, count(*) AS times FROM (SELECT id AS text, token FROM {tokens_sql("SELECT DISTINCT text AS id, text FROM ask")}) WHERE token NOT IN ({STOP}) GROUP BY ALL
), scored AS (SELECT deal, q, doc, round(sum(times * idf * impact), 9) AS score FROM ask JOIN word USING (text) JOIN term_ USING (deal, term) JOIN posting USING (deal, term) GROUP BY ALL
), b AS (
  SELECT deal, q, text, doc, status, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY deal, q ORDER BY coalesce(score, 0) DESC, doc)), 9) AS fused
  FROM ask JOIN len_ USING (deal) LEFT JOIN scored USING (deal, q, doc) QUALIFY row_number() OVER (PARTITION BY deal, q ORDER BY coalesce(score, 0) DESC, doc) <= 30
), w AS (SELECT deal, q, term, coalesce(idf, 2.0::DOUBLE) * CASE WHEN regexp_matches(term, '[0-9]') THEN 3 ELSE 1 END AS weight FROM (SELECT DISTINCT deal, q, term FROM ask JOIN word USING (text)) LEFT JOIN term_ USING (deal, term)
), r AS (SELECT deal, q, doc, sum(CASE WHEN tf IS NOT NULL THEN weight ELSE 0 END) / sum(weight) AS rerank FROM b JOIN w USING (deal, q) LEFT JOIN posting USING (deal, doc, term) GROUP BY ALL
), g AS (
  SELECT b.*, CASE WHEN max(rerank) OVER p - min(rerank) OVER p < 1e-12 THEN 1 ELSE (rerank - min(rerank) OVER p) / (max(rerank) OVER p - min(rerank) OVER p) END AS x,
    CASE WHEN max(fused) OVER p - min(fused) OVER p < 1e-12 THEN 1 ELSE (fused - min(fused) OVER p) / (max(fused) OVER p - min(fused) OVER p) END AS y
  FROM b JOIN r USING (deal, q, doc) WINDOW p AS (PARTITION BY deal, q)
), hit AS (
  SELECT deal, q, doc, row_number() OVER (PARTITION BY deal, q ORDER BY round(({first}) * {weight}, 9) DESC, fused DESC, doc) AS rank FROM g QUALIFY rank <= {k}
)"""


def _recall_sql(stages: str, **options) -> str:
    asked = "SELECT fact AS q, deal, question AS text FROM facts WHERE answerable"
    return f"""(WITH {deals.DEALS_SQL}, {deals.CHUNKS_SQL}, {deals.FACTS_SQL}, {search_sql(asked, 10, **options)}, seen AS (
    SELECT q, document, page, row_number() OVER (PARTITION BY q ORDER BY min(rank), document || '#' || page) AS place FROM hit JOIN chunk ON chunk = doc GROUP BY q, document, page
  ), ranks AS (SELECT fact_type, place AS rank FROM facts LEFT JOIN seen ON q = fact AND seen.document = facts.document AND seen.page = facts.page WHERE answerable)
  SELECT '{stages}' AS stages, fact_type, count(*) AS n, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_{k}" for k in (1, 3, 5, 10))},
    round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM ranks GROUP BY fact_type)"""


DEAL_RECALL = f"SELECT * FROM {_recall_sql('bm25', rerank=False, authority=False)} UNION ALL SELECT * FROM {_recall_sql('full')}"


def deal_answers(spark, sf_dir):
    """Every fact's question answered from the five chunks found for it among its deal's, and checked: right page, right figure, right
    refusal, and every figure of the answer held against the pages."""
    rows, chunks = packages(spark, sf_dir)
    facts = storage.written(deals.facts(rows), "facts")
    asked = facts.select(F.col("fact").alias("question"), "deal", F.col("question").alias("text"))
    contexts = answering.retrieved(chunks, asked, 5)
    answers = storage.written(answering.answered(asked, contexts), "answers")
    gold = facts.select(F.col("fact").alias("question"), "document", "page", F.col("answer_text").alias("value"), "answerable")
    found = answering.evaluated(asked, contexts, answers, gold)
    return found.select("question", "refused", "citation_correct", "answer_correct", "refusal_correct", F.round("grounding_rate", 6).alias("grounding_rate"), "hallucinated", "invented")


_FIGURES = "list_filter(list_transform(regexp_extract_all({0}, '\\$?\\d[\\d,]*\\.?\\d*%?x?'), lambda f: regexp_replace(ltrim(f, '$'), '[.,;:]+$', '')), lambda f: length(regexp_replace(f, '[^0-9]', '', 'g')) >= 2)"
#: The best line of the chunks found, scored by the question's words; what it says held against the fact and against the pages.
DEAL_ANSWERS = f"""WITH {deals.DEALS_SQL}, {deals.CHUNKS_SQL}, {deals.FACTS_SQL}, {search_sql("SELECT fact AS q, deal, question AS text FROM facts", 5)}, ctx AS (
  SELECT q, document, page, text FROM hit JOIN chunk ON chunk = doc
), line AS (
  SELECT q, document, page, ln, trim(l) AS line FROM (SELECT *, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM ctx) WHERE length(trim(l)) >= 8
), own AS (SELECT DISTINCT id AS line, token AS term FROM {tokens_sql("SELECT DISTINCT line AS id, line AS text FROM line")}
), size_ AS (SELECT line, count(*) AS m FROM own GROUP BY line), terms AS (SELECT text, count(*) AS n FROM word GROUP BY text
), matched AS (SELECT text, line, count(*) AS c FROM word JOIN own USING (term) GROUP BY ALL
), best AS (
  SELECT q, document, page, line, coalesce(c, 0)::DOUBLE / n / (1 + coalesce(m, 0) / 40::DOUBLE) AS score FROM line JOIN ask USING (q) JOIN terms USING (text) LEFT JOIN size_ USING (line) LEFT JOIN matched USING (text, line)
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, document, page, ln) = 1
), said AS (SELECT fact, answerable, f.document AS gold, f.page AS gold_page, answer_text AS v, coalesce(score < 0.18, TRUE) AS refused, b.document, b.page, line, {_FIGURES.format("line")} AS figures FROM facts f LEFT JOIN best b ON q = fact
), there AS (SELECT q, document, page, {_FIGURES.format("string_agg(text, chr(10))")} AS figures FROM ctx GROUP BY ALL
), anywhere AS (SELECT q, flatten(list(figures)) AS every FROM there GROUP BY q
), held AS (
  SELECT s.*, len(list_filter(s.figures, lambda x: list_contains(t.figures, x))) AS good, len(list_filter(s.figures, lambda x: NOT list_contains(every, x))) AS bad, t.q IS NULL AS lost
  FROM said s LEFT JOIN there t ON t.q = fact AND t.document = s.document AND t.page = s.page LEFT JOIN anywhere a ON a.q = fact
)
SELECT fact AS question, refused, CASE WHEN gold IS NULL THEN refused ELSE NOT refused AND document = gold AND page = gold_page END AS citation_correct,
  CASE WHEN v IS NULL THEN TRUE WHEN refused THEN FALSE WHEN v LIKE '(%' THEN contains(line, v) ELSE list_contains(figures, v) END AS answer_correct, CASE WHEN NOT answerable THEN refused END AS refusal_correct,
  round(CASE WHEN refused OR len(figures) = 0 THEN 1.0::DOUBLE ELSE good::DOUBLE / len(figures) END, 6) AS grounding_rate, CASE WHEN refused THEN 0 ELSE bad END AS hallucinated, CASE WHEN lost AND NOT refused THEN 1 ELSE 0 END AS invented FROM held"""


def notes(rows):
    """What the drafter of some deals says besides the template: a pro forma that follows from the file, a figure that follows from nothing, and
    one that is replaced by another such when it is written again."""
    k, debt = F.col("k"), F.col("total_debt") + F.col("facility")
    ratio = F.when(F.col("ebitda") > 0, F.concat(F.lit(" and pro forma leverage to "), X.fixed(debt / F.col("ebitda"), 2), F.lit("x")))
    pro_forma = F.concat(F.lit("  The facility would bring total debt to $"), F.format_number(debt, 0), F.coalesce(ratio, F.lit("")), F.lit("."))
    backlog = lambda n: F.lit(f"  The order backlog stands at ${n}.")
    said = F.array(
        F.when(k % 4 == 1, F.struct(F.lit(1).alias("pass"), pro_forma.alias("sentence"))),
        F.when(k % 4 == 2, F.struct(F.lit(1).alias("pass"), backlog("777,777,777,777").alias("sentence"))),
        F.when(k % 8 == 3, F.struct(F.lit(1).alias("pass"), backlog("888,888,888,888").alias("sentence"))),
        F.when(k % 8 == 3, F.struct(F.lit(2).alias("pass"), backlog("999,999,999,999").alias("sentence"))),
    )
    return rows.select("deal", F.explode(F.filter(said, lambda s: s.isNotNull())).alias("s")).select("deal", "s.*")


def memo_runs(spark, sf_dir):
    """Memos of all deals, written from what their searches found, verified, and revised once where a figure stands on nothing."""
    rows, chunks = packages(spark, sf_dir)
    out = memo.runs(chunks, rows, notes(rows)).results
    return out.select("deal", "stated", "revised", "verified", "citations", "n_figures", "computed", "policy", "printed", "reconstructible", "issue", "calculations", "figures_read")


_ASKED = "SELECT deal, n AS q, text FROM deals, (VALUES " + ", ".join(f"({n}, '{q.replace(chr(39), chr(39) * 2)}')" for n, (_, q) in enumerate([*memo.QUESTIONS, memo.DETAIL])) + ") v(n, text)"
_LABELS = ", ".join(f"('{label}', '{key}')" for label, key in statements.LABELS)
#: Contexts in order, rows of final ones, the first row of each label, and figures as columns of one row a deal.
READ_SQL = f"""{deals.DEALS_SQL}, {deals.CHUNKS_SQL}, {search_sql(_ASKED, 6)}, pooled AS (
  SELECT deal, doc, min_by(q, q * 100 + rank) AS q, min(q * 100 + rank) AS o FROM hit GROUP BY deal, doc
), ctx AS (SELECT p.deal, p.doc, p.q, row_number() OVER (PARTITION BY p.deal ORDER BY o, p.doc) - 1 AS place, document, page, kind, status, scale, text FROM pooled p JOIN chunk ON chunk = p.doc
), line AS (
  SELECT deal, place, document, page, scale, ln, list_transform(string_split(l, '|'), lambda c: trim(c)) AS cells
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM ctx WHERE status = 'final') WHERE contains(l, '|')
), numbered AS (
  SELECT *, list_transform(list_filter(cells[2:], lambda c: regexp_matches(c, '[0-9]')), lambda c: CAST(regexp_replace(c, '[^0-9]', '', 'g') AS DOUBLE) * CASE WHEN c LIKE '(%)' THEN -1 ELSE 1 END * scale) AS series FROM line
), row_ AS (SELECT deal, key, place, ln, series, document, page FROM numbered JOIN (VALUES {_LABELS}) v(label, key) ON lower(cells[1]) = label WHERE len(series) > 0
), fig AS (SELECT deal, key, place, ln, series[-1] AS value, CASE WHEN len(series) > 1 THEN series[-2] END AS prior, series[1] AS earliest, document, page FROM row_ QUALIFY row_number() OVER (PARTITION BY deal, key ORDER BY place, ln) = 1
)"""
_OF = lambda key, what="value": f"max({what}) FILTER (key = '{key}')"
_WIDE = ", ".join(f"{_OF(key)} AS {key}" for _, key in statements.LABELS)
#: Receivables pages: totals and buckets by their words, customers by a share in the third cell.
BOOK_SQL = """book AS (
  SELECT deal, max_by(cells[2], place * 1000 + ln) FILTER (lower(cells[1]) LIKE 'total accounts receivable%') AS total, max_by(cells[2], place * 1000 + ln) FILTER (lower(cells[1]) LIKE 'over 90%') AS over_90,
    list(TRY_CAST(replace(cells[2], ',', '') AS BIGINT) ORDER BY TRY_CAST(replace(cells[2], ',', '') AS BIGINT) DESC) FILTER (cells[3] LIKE '%\\%' ESCAPE '\\' AND lower(cells[1]) <> 'customer') AS owed
  FROM line WHERE document LIKE '%aging%' GROUP BY deal
), owing AS (SELECT deal, CAST(replace(total, ',', '') AS DOUBLE) AS t, CAST(replace(over_90, ',', '') AS DOUBLE) AS o, CAST(owed[1] AS DOUBLE) AS c1, CAST(list_sum(owed[1:5]) AS DOUBLE) AS c5 FROM book)"""


def receivables_ageing(spark, sf_dir):
    """Receivables of every deal as its ageing pages print them, the two tables of which are chunks of their own."""
    _, chunks = packages(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("deal").orderBy("chunk_id")).alias("place")
    own = chunks.filter(F.col("document").rlike("aging")).select("deal", order, "document", "page", "status", memo.context_rows("text").alias("rows"))
    book = statements.receivables_book(own)
    log = statements.calculation_log(book).groupBy("deal").pivot("name", ["receivables over 90 days", "customer concentration", "top five customer concentration"]).agg(F.first("value"))
    wide = book.groupBy("deal").pivot("key", ["total receivables", "over 90 days", "largest customer", "top five customers"]).agg(F.first("value"))
    names = {"total receivables": "total", "over 90 days": "over_90", "largest customer": "largest", "top five customers": "top_five", "receivables over 90 days": "over_90_share", "customer concentration": "concentration", "top five customer concentration": "top_five_share"}
    out = wide.join(log, "deal").withColumnsRenamed(names)
    return out.select("deal", *(F.col(c).cast("long").alias(c) for c in ("total", "over_90", "largest", "top_five")), *(F.round(c, 6).alias(c) for c in ("over_90_share", "concentration", "top_five_share")))


RECEIVABLES_AGEING = f"""WITH {deals.DEALS_SQL}, d AS (
  SELECT deal, receivables AS t, {deals.divided("receivables * (2 + k % 7) / 100", "//")} AS o, list_reverse_sort([{", ".join(deals.divided(f"receivables * {s} / 100", "//") for s in deals.SHARES)}]) AS c FROM deals
)
SELECT deal, CAST(t AS BIGINT) AS total, CAST(o AS BIGINT) AS over_90, CAST(c[1] AS BIGINT) AS largest, CAST(list_sum(c[1:5]) AS BIGINT) AS top_five,
  round(o * 100.0::DOUBLE / t, 6) AS over_90_share, round(c[1] * 100.0::DOUBLE / t, 6) AS concentration, round(list_sum(c[1:5]) * 100.0::DOUBLE / t, 6) AS top_five_share FROM d WHERE t > 0"""


def _money(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


_REQUIRED = "CASE WHEN {lev} IS NULL OR {cov} IS NULL THEN 'DEFER' WHEN {lev} <= 3.5 AND {cov} >= 1.25 THEN 'PROCEED' ELSE 'DECLINE' END"
#: Calculations over a deal's figures, and what each may be printed as.
WORKED_SQL = f"""wide AS (SELECT deal, {_WIDE}, {_OF("revenue", "prior")} AS p_revenue, {_OF("ebitda", "prior")} AS p_ebitda, CASE WHEN {_OF("cash", "prior")} IS NOT NULL THEN {_OF("cash", "earliest")} END AS e_cash,
    count(*) AS n_read, count(prior) FILTER (key IN ('revenue', 'ebitda', 'cash')) AS n_prior FROM fig GROUP BY deal
), worked AS (
  SELECT *, current_portion_ltd + ltd_noncurrent AS debt, CASE WHEN ebitda > 0 THEN (current_portion_ltd + ltd_noncurrent) / ebitda END AS lev,
    CASE WHEN abs(interest) + abs(principal) > 0 THEN (ebitda - abs(capex) - abs(taxes)) / (abs(interest) + abs(principal)) END AS cov,
    CASE WHEN current_liabilities > 0 THEN current_assets / current_liabilities END AS cur, abs(gross_profit) * 100 / nullif(abs(revenue), 0) AS gm, abs(ebitda) * 100 / nullif(abs(revenue), 0) AS em,
    abs(net_income) * 100 / nullif(abs(revenue), 0) AS nm, ebitda / nullif(abs(interest), 0) AS ic, (revenue - p_revenue) * 100 / nullif(abs(p_revenue), 0) AS rg,
    (ebitda - p_ebitda) * 100 / nullif(abs(p_ebitda), 0) AS eg, (cash - e_cash) * 100 / nullif(abs(e_cash), 0) AS cc, abs(o) * 100 / nullif(abs(t), 0) AS o9, CASE WHEN t > 0 THEN c1 * 100 / t END AS cn, c5, abs(c5) * 100 / nullif(abs(t), 0) AS c5s, t, o, c1
  FROM wide LEFT JOIN owing USING (deal)
), calc AS (SELECT deal, unnest([debt, lev, cov, cur, gm, em, nm, ic, rg, eg, cc, o9, cn, c5, c5s]) AS v, unnest(['USD', 'x', 'x', 'x', 'percent', 'percent', 'percent', 'x', 'percent', 'percent', 'percent', 'percent', 'percent', 'USD', 'percent']) AS unit FROM worked
), form AS (
  SELECT DISTINCT deal, unnest(CASE unit WHEN 'USD' THEN [{_money("v")}, CAST(CAST(v AS BIGINT) AS VARCHAR)] WHEN 'x' THEN [printf('%.2f', v) || 'x', printf('%.2f', v), printf('%.1f', v) || 'x', printf('%.1f', v)]
    ELSE [printf('%.1f', v), printf('%.1f', v) || '%', printf('%.0f', v), printf('%.0f', v) || '%', printf('%.1f', abs(v)), printf('%.1f', abs(v)) || '%', printf('%.0f', abs(v)), printf('%.0f', abs(v)) || '%'] END) AS f FROM calc WHERE v IS NOT NULL
)"""
_DRAFTED = [*(_money(k) for k in ("revenue", "ebitda", "net_income", "cash", "total_assets", "total_equity", "debt")), *(f"printf('%.2f', {v}) || 'x'" for v in ("lev", "cov", "cur", "lev", "cov")),
            "CASE WHEN lev IS NOT NULL THEN '3.5x' END", "CASE WHEN cov IS NOT NULL THEN '1.25x' END", "CASE WHEN cur < 1.1 THEN printf('%.2f', cur) || 'x' END"]
_CITED = ["revenue", "ebitda", "net_income", "cash", "total_assets", "total_equity"]
#: Inputs of what the memo prints with its sources, where it has a value.
_BEHIND = {"debt": ("current_portion_ltd", "ltd_noncurrent"), "lev": ("current_portion_ltd", "ltd_noncurrent", "ebitda"), "cov": ("ebitda", "capex", "taxes", "interest", "principal"), "cur": ("current_assets", "current_liabilities")}
_POLICY = ", ".join(f"'{f}'" for f in memo.POLICY_FORMS)
MEMO_RUNS = f"""WITH {READ_SQL}, {BOOK_SQL}, {WORKED_SQL}, said AS (
  SELECT deal, f, 0 AS aside FROM (SELECT deal, unnest([{", ".join(_DRAFTED)}]) AS f FROM worked) WHERE f IS NOT NULL
  UNION ALL SELECT deal, unnest([{_money("d.total_debt + d.facility")}, CASE WHEN d.ebitda > 0 THEN printf('%.2f', (d.total_debt + d.facility) / d.ebitda) || 'x' END]), 1 FROM deals d WHERE k % 4 = 1
  UNION ALL SELECT deal, '777,777,777,777', 2 FROM deals WHERE k % 4 = 2
  UNION ALL SELECT deal, '999,999,999,999', 3 FROM deals WHERE k % 8 = 3
), shown AS (SELECT DISTINCT deal, rtrim(replace(unnest(regexp_extract_all(text, '\\d[\\d,]*\\.?\\d*')), ',', ''), '.') AS f FROM ctx
), stands AS (
  SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM form WHERE form.deal = s.deal AND form.f IN (s.f, regexp_replace(s.f, '[^0-9.]', '', 'g'))) THEN 'computed' WHEN s.f IN ({_POLICY}) THEN 'policy'
    WHEN EXISTS (SELECT 1 FROM shown WHERE shown.deal = s.deal AND shown.f = regexp_replace(s.f, '[^0-9.]', '', 'g')) THEN 'printed'
    WHEN aside = 1 AND w.debt IS NOT NULL AND w.facility_requested IS NOT NULL AND w.ebitda IS NOT NULL AND length(regexp_replace(regexp_replace(s.f, '[^0-9]', '', 'g'), '^0+|0+$', '', 'g')) >= 3 THEN 'reconstructible' ELSE 'issue' END AS standing
  FROM said s JOIN worked w USING (deal) WHERE f IS NOT NULL
), sentence AS (SELECT *, aside = 2 OR aside = 1 AND bool_or(standing = 'issue' AND aside = 1) OVER (PARTITION BY deal) AS cut FROM stands
), counted AS (
  SELECT deal, count(*) FILTER (NOT cut) AS n_figures, {", ".join(f"count(*) FILTER (standing = '{s}' AND NOT cut) AS {s}" for s in ("computed", "policy", "printed", "reconstructible", "issue"))}, bool_or(standing = 'issue') AS revised FROM sentence GROUP BY deal
), cited AS (
  SELECT deal, count(DISTINCT document || '#' || page) AS citations FROM fig JOIN worked USING (deal) WHERE key IN ({", ".join(f"'{k}'" for k in _CITED)})
    {" ".join(f"OR {v} IS NOT NULL AND key IN ({', '.join(repr(k) for k in keys)})" for v, keys in _BEHIND.items())} GROUP BY deal
)
SELECT deal, {_REQUIRED.format(lev="lev", cov="cov")} AS stated, revised, issue = 0 AS verified, CAST(coalesce(citations, 0) AS INTEGER) AS citations, n_figures, computed, policy, printed, reconstructible, issue,
  (SELECT count(*) FROM calc WHERE calc.deal = w.deal AND v IS NOT NULL) AS calculations,
  n_read + n_prior + (t IS NOT NULL)::BIGINT + (o IS NOT NULL)::BIGINT + 2 * (c1 IS NOT NULL)::BIGINT AS figures_read
FROM worked w JOIN counted USING (deal) LEFT JOIN cited USING (deal)"""


def deal_review_items(spark, sf_dir):
    """What the memos of all deals leave for a reviewer, by kind: figures that a derivation explains, or nothing does, identities that the file's
    figures break, and instructions that stand in its documents, whether or not a search finds them."""
    rows, chunks = packages(spark, sf_dir)
    run = memo.runs(chunks, rows, notes(rows))
    read = run.figures.filter(F.col("key").isin([k for _, k in statements.LABELS])).select("deal", "key", "value")
    wide = storage.written(read.groupBy("deal").pivot("key", [k for _, k in statements.LABELS]).agg(F.first("value")), "figures")
    checks = run.checks.withColumn("standing", F.when(F.col("standing") == "reconstructible", "issue").otherwise(F.col("standing")))
    found = chunks.select("deal", "document", X.instruction_kind("text").alias("kind")).filter("kind IS NOT NULL")
    items = memo.review_items(memo.decided_by(read), checks, statements.identity_findings(wide), found)
    return items.groupBy("kind", "priority").agg(F.count("*").alias("n"), F.countDistinct("deal").alias("deals"))


DEAL_REVIEW_ITEMS = f"""{{memo}}, broken AS (
  SELECT deal, unnest([CASE WHEN abs(abs(revenue) - abs(cogs) - abs(gross_profit)) > 0.02 * greatest(abs(gross_profit), 1) THEN 'gross' END, CASE WHEN abs(ebitda) > abs(gross_profit) * 1.02 THEN 'ebitda' END,
    CASE WHEN abs(abs(current_liabilities) + abs(ltd_noncurrent) + abs(total_equity) - abs(total_assets)) > 0.02 * greatest(abs(total_assets), 1) THEN 'balance' END]) AS identity FROM wide
), item AS (
  SELECT DISTINCT deal, CASE standing WHEN 'issue' THEN 'low_confidence_extraction' ELSE 'reconstruction' END AS kind, f AS what FROM sentence WHERE NOT cut AND standing IN ('issue', 'reconstructible')
  UNION ALL SELECT deal, 'accounting_inconsistency', identity FROM broken WHERE identity IS NOT NULL
  UNION ALL SELECT DISTINCT deal, 'injection_finding', document FROM chunk WHERE {page_queries.any_instruction_sql("@").replace("'@'", "text")}
)
SELECT kind, list_position([{", ".join(f"'{k}'" for k in operations.PRIORITY)}], kind) - 1 AS priority, count(*) AS n, count(DISTINCT deal) AS deals FROM item GROUP BY ALL""".replace("{memo}", MEMO_RUNS[: MEMO_RUNS.index("\nSELECT deal, CASE")])


def attack_outcomes(spark, sf_dir):
    """Every attack on every deal through what its searches return, counted by attack: errors, decisions that changed or grew stricter,
    looser ones if no identity were checked, and those that were let through."""
    rows, chunks = packages(spark, sf_dir)
    hits, contexts = memo.gather(chunks, rows)
    hits = hits.join(chunks.select(F.col("chunk_id").alias("doc"), "kind"), "doc")
    attacks = spark.createDataFrame(ATTACKS, "attack string, family string, target string, payload string")
    return operations.attack_outcomes(memo.attacked(hits, contexts, attacks))


_PAYLOADS = {"raised_ebitda": ("ebitda", 99e9), "lowered_debt": ("ltd_noncurrent", 1.0), "lowered_interest": ("interest", 1.0), "raised_capex": ("capex", 99e9), "endless_amount": ("ebitda", float("inf"))}
ATTACK_OUTCOMES = f"""WITH {READ_SQL}, target AS (
  SELECT hit.deal, hit.q, min_by(doc, rank) FILTER (kind = 'financial_statements') AS s, min_by(doc, rank) AS f FROM hit JOIN chunk ON chunk = doc GROUP BY ALL
), spot AS (SELECT ctx.deal, place, CASE WHEN s IS NULL THEN 1000000 ELSE -1000000 END AS ln FROM target JOIN ctx ON ctx.deal = target.deal AND ctx.q = target.q AND ctx.doc = coalesce(s, f) WHERE status = 'final'
), put AS (SELECT deal, min(struct_pack(place := place, ln := ln)) AS o FROM spot GROUP BY deal
), attack AS (SELECT * FROM (VALUES ('', '', FALSE, '', 0::DOUBLE), {", ".join(f"('{n}', '{f}', {page_queries.any_instruction_sql(p)}, '{_PAYLOADS.get(n, ('', 0))[0]}', {repr(_PAYLOADS.get(n, ('', 0.0))[1]) if _PAYLOADS.get(n, ('', 0.0))[1] != float('inf') else "'inf'"}::DOUBLE)" for n, f, _, p in ATTACKS)}) v(attack, family, detected, pkey, pvalue)
), keyed AS (SELECT DISTINCT deal, key FROM fig UNION SELECT deal, pkey FROM put, attack WHERE pkey <> ''
), read_ AS (
  SELECT attack, keyed.deal, keyed.key, CASE WHEN pkey = keyed.key AND put.o IS NOT NULL AND (fig.place IS NULL OR put.o < struct_pack(place := fig.place, ln := fig.ln)) THEN pvalue ELSE fig.value END AS value
  FROM keyed CROSS JOIN attack LEFT JOIN fig ON fig.deal = keyed.deal AND fig.key = keyed.key LEFT JOIN put ON put.deal = keyed.deal
), facing AS (
  SELECT attack, deal, bool_or(abs(value) = 'inf'::DOUBLE) AS lost, {_WIDE.replace("max(value)", "max(CASE WHEN abs(value) < 'inf'::DOUBLE THEN value END)")} FROM read_ WHERE value IS NOT NULL GROUP BY ALL
), x AS (
  SELECT *, CASE WHEN ebitda > 0 THEN (current_portion_ltd + ltd_noncurrent) / ebitda END AS lev, CASE WHEN abs(interest) + abs(principal) > 0 THEN (ebitda - abs(capex) - abs(taxes)) / (abs(interest) + abs(principal)) END AS cov,
    coalesce(abs(abs(revenue) - abs(cogs) - abs(gross_profit)) > 0.02 * greatest(abs(gross_profit), 1), FALSE) OR coalesce(abs(ebitda) > abs(gross_profit) * 1.02, FALSE)
    OR coalesce(abs(abs(current_liabilities) + abs(ltd_noncurrent) + abs(total_equity) - abs(total_assets)) > 0.02 * greatest(abs(total_assets), 1), FALSE) AS blocked FROM facing
), d AS (SELECT *, {_REQUIRED.format(lev="lev", cov="cov")} AS decision FROM x
), e AS (
  SELECT a.attack, family, detected, d.lost, d.decision, c.decision AS baseline, d.blocked AS held, d.blocked AND NOT c.blocked AS blocked, list_position(['DECLINE', 'DEFER', 'PROCEED'], d.decision) - list_position(['DECLINE', 'DEFER', 'PROCEED'], c.decision) AS step
  FROM d JOIN attack a USING (attack) JOIN d c ON c.deal = d.deal AND c.attack = '' WHERE d.attack <> ''
)
SELECT attack, family, any_value(detected) AS detected, count(*) AS n, count_if(lost) AS errors, count_if(NOT lost AND step <> 0) AS changed, count_if(NOT lost AND step < 0) AS conservative,
  count_if(NOT lost AND step > 0) AS unguarded, count_if(NOT lost AND blocked) AS blocked, count_if(NOT lost AND step > 0 AND NOT held) AS successes FROM e GROUP BY ALL"""

QUERIES = {
    "deal_facts": (deal_facts, DEAL_FACTS),
    "deal_recall": (deal_recall, DEAL_RECALL),
    "deal_answers": (deal_answers, DEAL_ANSWERS),
    "receivables_ageing": (receivables_ageing, RECEIVABLES_AGEING),
    "memo_runs": (memo_runs, MEMO_RUNS),
    "deal_review_items": (deal_review_items, DEAL_REVIEW_ITEMS),
    "attack_outcomes": (attack_outcomes, ATTACK_OUTCOMES),
}
