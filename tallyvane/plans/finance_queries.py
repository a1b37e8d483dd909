"""Queries of statements, metrics, extraction, identities, reconstruction and grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.functions import text as X
from tallyvane.operators import evaluate, statements
from tallyvane.sources import tables

#: Lines of accounts by whole-number arithmetic on revenue (r), nation (k) and year (y): the same text is Spark SQL and DuckDB SQL.
LINES = {
    "cogs": "r * (55 + k % 10) / 100",
    "opex": "r * 20 / 100",
    "depreciation": "r * 4 / 100",
    "interest": "r * (2 + y % 3) / 100",
    "taxes": "r * 3 / 100",
    "cash": "r * 10 / 100",
    "receivables": "r * (14 + y % 4) / 100",
    "inventory": "r * 12 / 100",
    "fixed_assets": "r * 50 / 100",
    "payables": "r * 9 / 100",
    "current_portion": "r * 5 / 100",
    "long_term_debt": "r * (20 + k * 3) / 100",
    "capex": "r * 6 / 100",
    "principal": "r * 5 / 100",
}


def accounts(spark, sf_dir):
    """Accounts of every nation as a borrower, by year of order: revenue from its customers' lines, exact in whole dollars."""
    t = lambda n: tables.table(spark, sf_dir, n)
    units = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    revenue = sold.groupBy(F.col("c_nationkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.expr("1").alias("one"), F.sum(units).alias("u"))
    rows = revenue.withColumn("r", F.expr("u div 10000"))
    return rows.select(F.concat(F.lit("NAT-"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("borrower"), "k", F.col("y").alias("year"), F.col("r").alias("revenue"), *(F.expr(e.replace(" / ", " div ")).cast("long").alias(n) for n, e in LINES.items()))


ACCOUNTS = f"""
WITH sold AS (
  SELECT c_nationkey AS k, year(o_orderdate) AS y,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) // 10000 AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
), lines AS (
  SELECT 'NAT-' || lpad(CAST(k AS VARCHAR), 4, '0') AS borrower, k, y AS year, r AS revenue, {", ".join(f"CAST({e.replace(' / ', ' // ')} AS BIGINT) AS {n}" for n, e in LINES.items())} FROM sold
), a AS (
  SELECT *, revenue - cogs AS gross_profit, revenue - cogs - opex AS ebitda, cash + receivables + inventory AS total_current_assets,
    payables + current_portion AS total_current_liabilities, current_portion + long_term_debt AS total_debt,
    cash + receivables + inventory + fixed_assets AS total_assets,
    revenue - cogs - opex - depreciation - interest - taxes AS net_income, lag(revenue) OVER w AS prior_revenue,
    coalesce(receivables - lag(receivables) OVER w, 0) AS d_receivables, coalesce(inventory - lag(inventory) OVER w, 0) AS d_inventory,
    coalesce(payables - lag(payables) OVER w, 0) AS d_payables
  FROM lines WINDOW w AS (PARTITION BY borrower ORDER BY year)
)"""


def statement_identities(spark, sf_dir):
    full = statements.identities(accounts(spark, sf_dir))
    return full.select("borrower", "year", "revenue", "gross_profit", "ebitda", "net_income", "total_assets", "total_debt", "total_equity", "cfo", "cfi", (F.col("total_liabilities") + F.col("total_equity") == F.col("total_assets")).alias("balanced"))


STATEMENT_IDENTITIES = f"""{ACCOUNTS}
SELECT borrower, year, revenue, gross_profit, ebitda, net_income, total_assets, total_debt, total_assets - payables - total_debt AS total_equity,
  net_income + depreciation - d_receivables - d_inventory + d_payables AS cfo, -capex AS cfi, TRUE AS balanced FROM a"""


def credit_metrics(spark, sf_dir):
    out = statements.metrics(statements.identities(accounts(spark, sf_dir)))
    return out.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


CREDIT_METRICS = f"""{ACCOUNTS}, m AS (
  SELECT *, CASE WHEN ebitda > 0 THEN total_debt / ebitda END AS leverage, CASE WHEN interest + principal > 0 THEN (ebitda - capex - taxes) / (interest + principal) END AS dscr FROM a
)
SELECT borrower, year, round(leverage, 6) AS leverage, round(dscr, 6) AS dscr,
  round(CASE WHEN total_current_liabilities > 0 THEN total_current_assets / total_current_liabilities END, 6) AS current_ratio,
  round(CASE WHEN revenue <> 0 THEN abs(gross_profit) * 100 / abs(revenue) END, 6) AS gross_margin,
  round(CASE WHEN revenue <> 0 THEN abs(ebitda) * 100 / abs(revenue) END, 6) AS ebitda_margin,
  round(CASE WHEN revenue <> 0 THEN abs(cogs) * 100 / abs(revenue) END, 6) AS cogs_share,
  round(CASE WHEN interest <> 0 THEN ebitda / abs(interest) END, 6) AS interest_coverage,
  round(CASE WHEN prior_revenue <> 0 THEN (revenue - prior_revenue) * 100 / abs(prior_revenue) END, 6) AS revenue_growth,
  CASE WHEN leverage IS NULL OR dscr IS NULL THEN 'DEFER' WHEN leverage <= 3.5 AND dscr >= 1.25 THEN 'PROCEED' ELSE 'DECLINE' END AS required
FROM m"""

_PRINTED = [("Revenue", "revenue"), ("Cost of goods sold", "cogs"), ("Gross profit", "gross_profit"), ("EBITDA", "ebitda"), ("Net income", "net_income"), ("Interest expense", "-interest"), ("Total assets", "total_assets")]


def statement_pages(spark, sf_dir):
    """Printed statements: per borrower and year a table of label, prior year and year, parentheses for negatives."""
    full = statements.identities(accounts(spark, sf_dir))
    rows = F.array(*(F.array(F.lit(label), F.lit(""), X.money_text(F.expr(e))) for label, e in _PRINTED))
    return full.select(
        F.concat_ws("-", "borrower", "year").alias("deal"),
        F.lit(0).alias("place"),
        F.when(F.col("year") % 5 == 4, "draft").otherwise("final").alias("status"),
        F.lit(1).alias("scale"),
        F.lit("02_financial_statements_comparative.pdf").alias("document"),
        F.lit(1).alias("page"),
        rows.alias("rows"),
    )


def extracted_figures(spark, sf_dir):
    """Figures read back from printed statements of final status."""
    return statements.extract_figures(statement_pages(spark, sf_dir)).select("deal", "key", F.col("value").cast("long").alias("value"))


_KEYS = [("revenue", "revenue"), ("cogs", "cogs"), ("gross_profit", "gross_profit"), ("ebitda", "ebitda"), ("net_income", "net_income"), ("interest", "-interest"), ("total_assets", "total_assets")]
EXTRACTED_FIGURES = f"{ACCOUNTS} " + " UNION ALL ".join(f"SELECT borrower || '-' || year AS deal, '{k}' AS key, {e} AS value FROM a WHERE year % 5 <> 4" for k, e in _KEYS)


def receivable_concentration(spark, sf_dir):
    """Receivables of every nation: its customers' open orders, in whole cents."""
    t = lambda n: tables.table(spark, sf_dir, n)
    owed = t("orders").filter("o_orderstatus = 'O'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = owed.select(F.col("c_nationkey").alias("deal"), F.col("c_custkey").alias("customer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("balance"))
    out = statements.receivables(rows)
    return out.select("deal", "total", "customer", F.round("concentration", 6).alias("concentration"), F.round("top_share", 6).alias("top_share"), "concern")


RECEIVABLE_CONCENTRATION = """
WITH owed AS (
  SELECT c_nationkey AS deal, c_custkey AS customer, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY deal ORDER BY balance DESC, customer) AS r FROM owed)
SELECT deal, CAST(sum(balance) AS BIGINT) AS total, min(customer) FILTER (r = 1) AS customer, round(max(balance) * 100 / sum(balance), 6) AS concentration,
  round(sum(balance) FILTER (r <= 5) * 100 / sum(balance), 6) AS top_share, max(balance) * 100 / sum(balance) > 25 AS concern
FROM ranked GROUP BY deal"""


def broken_identities(spark, sf_dir):
    """Identities that poisoned accounts break: some gross profits raised, some EBITDA doubled, some assets changed."""
    full = statements.identities(accounts(spark, sf_dir))
    k = F.col("k")
    figures = full.select(
        F.concat_ws("-", "borrower", "year").alias("deal"),
        "revenue",
        "cogs",
        F.when(k % 5 == 0, F.expr("gross_profit * 11 div 10")).otherwise(F.col("gross_profit")).alias("gross_profit"),
        F.when(k % 7 == 1, F.col("gross_profit") * 2).otherwise(F.col("ebitda")).alias("ebitda"),
        F.col("total_current_liabilities").alias("current_liabilities"),
        F.col("long_term_debt").alias("ltd_noncurrent"),
        "total_equity",
        F.when(k % 6 == 2, F.col("total_assets") * 2).otherwise(F.col("total_assets")).alias("total_assets"),
    )
    return statements.identity_findings(figures)


BROKEN_IDENTITIES = f"""{ACCOUNTS}, f AS (
  SELECT borrower || '-' || year AS deal, revenue, cogs, CASE WHEN k % 5 = 0 THEN (gross_profit * 11) // 10 ELSE gross_profit END AS gp,
    CASE WHEN k % 7 = 1 THEN gross_profit * 2 ELSE ebitda END AS e, total_current_liabilities + long_term_debt + abs(total_assets - payables - total_debt) AS claims,
    CASE WHEN k % 6 = 2 THEN total_assets * 2 ELSE total_assets END AS assets FROM a
), c AS (
  SELECT deal, 'revenue less cost of goods sold equals gross profit' AS identity, revenue - cogs AS l, gp AS r, abs(revenue - cogs - gp) > 0.02 * greatest(gp, 1) AS broken FROM f
  UNION ALL SELECT deal, 'EBITDA cannot exceed gross profit', e, gp, e > gp * 1.02 FROM f
  UNION ALL SELECT deal, 'liabilities and equity equal assets', claims, assets, abs(claims - assets) > 0.02 * greatest(assets, 1) FROM f
)
SELECT deal, identity, CAST(l AS DOUBLE) AS "left", CAST(r AS DOUBLE) AS "right", CAST(l - r AS DOUBLE) AS gap FROM c WHERE broken"""


def explained_figures(spark, sf_dir):
    """Printed figures that one step from the accounts explains: leverage, EBITDA margin and net working assets of every
    borrower and year, and one figure that nothing explains."""
    full = statements.metrics(statements.identities(accounts(spark, sf_dir))).select("borrower", "year", "leverage", "ebitda_margin")
    own = statements.identities(accounts(spark, sf_dir)).join(full, ["borrower", "year"]).withColumn("deal", F.concat_ws("-", "borrower", "year"))
    names = ["revenue", "ebitda", "total_debt", "total_current_assets", "total_current_liabilities"]
    operands = own.select("deal", F.posexplode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in names))).alias("ord", "o"))
    operands = operands.select("deal", "ord", "o.label", "o.value", F.lit("USD").alias("kind"))
    printed = [F.concat(X.fixed("leverage", 2), F.lit("x")), F.concat(X.fixed("ebitda_margin", 1), F.lit("%")), F.format_number(F.col("total_current_assets") - F.col("total_current_liabilities"), 0), F.lit("77,777,777,777,777")]
    figures = own.select("deal", F.posexplode(F.array(*printed)).alias("place", "figure"))
    out = statements.explained(figures, statements.derivations(operands))
    return out.groupBy("place").agg(F.count("*").alias("n"), F.count("derivation").alias("explained"))


EXPLAINED_FIGURES = f"""{ACCOUNTS}, o AS (
  SELECT borrower || '-' || year AS deal, unnest([1, 2, 3, 4, 5]) AS i, unnest([revenue, ebitda, total_debt, total_current_assets, total_current_liabilities])::DOUBLE AS v FROM a
), pairs AS (SELECT x.deal, x.v AS a, y.v AS b FROM o x JOIN o y ON x.deal = y.deal AND x.i < y.i
), derived AS (
  SELECT deal, v, 'USD' AS kind FROM o UNION ALL SELECT deal, -v, 'USD' FROM o WHERE v < 0
  UNION ALL SELECT deal, unnest([a / nullif(b, 0), b / nullif(a, 0)]), 'x' FROM pairs
  UNION ALL SELECT deal, unnest([100 * a / nullif(b, 0), 100 * b / nullif(a, 0), 100 * (a - b) / nullif(abs(b), 0)]), 'percent' FROM pairs
  UNION ALL SELECT deal, unnest([a + b, a - b, b - a]), 'USD' FROM pairs
), figures AS (
  SELECT borrower || '-' || year AS deal, unnest([0, 1, 2, 3]) AS place, unnest([printf('%.2f', CASE WHEN ebitda > 0 THEN total_debt / ebitda END) || 'x', printf('%.1f', abs(ebitda) * 100 / nullif(abs(revenue), 0)) || '%',
    format('{{:,}}', total_current_assets - total_current_liabilities), '77,777,777,777,777']) AS figure FROM a
), shown AS (
  SELECT *, TRY_CAST(regexp_replace(figure, '[^0-9.-]', '', 'g') AS DOUBLE) AS s, power(10.0::DOUBLE, -length(regexp_extract(figure, '\\.(\\d+)', 1))) AS step,
    CASE WHEN figure LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN figure LIKE '%x' THEN 'x' ELSE 'USD' END AS kind,
    length(regexp_replace(regexp_replace(figure, '[^0-9]', '', 'g'), '^0+|0+$', '', 'g')) AS digits FROM figures
), scaled AS (SELECT deal, kind, v / unnest(CASE WHEN kind = 'USD' THEN [1, 1000, 1000000] ELSE [1] END) AS t, v FROM derived
), hit AS (
  SELECT DISTINCT f.deal, place FROM shown f JOIN scaled d ON f.deal = d.deal
  WHERE CASE WHEN s = 0 THEN abs(v) < 1e-9 ELSE digits >= 3 AND f.kind = d.kind
    AND (abs(sign(t) * floor(abs(t) / step + 1e-9) * step - s) < step / 1000 OR abs(round_even(t / step, 0) * step - s) < step / 1000) END
)
SELECT CAST(place AS INTEGER) AS place, count(*) AS n, count(hit.deal) AS explained FROM figures LEFT JOIN hit USING (deal, place) GROUP BY place"""


def _answers(spark, sf_dir):
    """Answers that quote an order's total and cite the customer's page of open (1) or other (2) orders, some figures raised by
    one and some citations of the wrong page; with the customers' pages as contexts."""
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("total"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("page"))
    said = F.when(F.col("o_orderkey") % 140 == 0, F.col("total") + 1).otherwise(F.col("total"))
    cited = F.when(F.col("o_orderkey") % 60 == 0, 3 - F.col("page")).otherwise(F.col("page"))
    answers = orders.select(F.col("o_orderkey").alias("answer"), F.concat(F.lit("The order came to $"), F.format_number(said, 0), F.lit(" [orders.pdf#p"), cited.cast("string"), F.lit("].")).alias("text"))
    pages = orders.groupBy("o_custkey", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("total")), lambda v: F.concat(F.lit("total "), F.format_number(v, 0))), "\n").alias("text"))
    contexts = orders.select(F.col("o_orderkey").alias("answer"), "o_custkey").join(pages, "o_custkey").select("answer", F.lit("orders.pdf").alias("document"), "page", "text")
    return answers, contexts


def grounded_figures(spark, sf_dir):
    answers, contexts = _answers(spark, sf_dir)
    return evaluate.grounding(answers, contexts)


_SAID = """
WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS total, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS page FROM orders),
said AS (SELECT o_orderkey AS answer, o_custkey, CASE WHEN o_orderkey % 140 = 0 THEN total + 1 ELSE total END AS v, CASE WHEN o_orderkey % 60 = 0 THEN 3 - page ELSE page END AS cited FROM o)
"""
GROUNDED_FIGURES = f"""{_SAID}
SELECT answer, 0 AS place, format('{{:,}}', v) AS figure,
  CASE WHEN bool_or(o.total = v AND o.page = cited) THEN 'grounded' WHEN bool_or(o.total = v) THEN 'uncited' ELSE 'absent' END AS bucket
FROM said JOIN o USING (o_custkey) GROUP BY answer, v"""


def grounding_summary(spark, sf_dir):
    answers, contexts = _answers(spark, sf_dir)
    rates = evaluate.grounding_rates(answers, evaluate.grounding(answers, contexts))
    dropped = evaluate.checked_citations(answers, contexts).agg(F.count_if(~F.col("kept")).alias("dropped"))
    sums = rates.agg(F.count("*").alias("answers"), F.round(F.avg("rate"), 6).alias("rate"), F.sum("hallucinated").alias("hallucinated"))
    return sums.crossJoin(dropped)  # one row each


GROUNDING_SUMMARY = f"""{_SAID}, b AS (
  SELECT answer, bool_or(o.total = v AND o.page = cited) AS good, bool_or(o.total = v) AS anywhere, bool_or(o.page = cited) AS kept FROM said JOIN o USING (o_custkey) GROUP BY answer
)
SELECT count(*) AS answers, round(avg(CASE WHEN good THEN 1.0 ELSE 0 END), 6) AS rate, count(*) FILTER (NOT anywhere) AS hallucinated, count(*) FILTER (NOT kept) AS dropped FROM b"""

QUERIES = {
    "statement_identities": (statement_identities, STATEMENT_IDENTITIES),
    "credit_metrics": (credit_metrics, CREDIT_METRICS),
    "extracted_figures": (extracted_figures, EXTRACTED_FIGURES),
    "receivable_concentration": (receivable_concentration, RECEIVABLE_CONCENTRATION),
    "broken_identities": (broken_identities, BROKEN_IDENTITIES),
    "explained_figures": (explained_figures, EXPLAINED_FIGURES),
    "grounded_figures": (grounded_figures, GROUNDED_FIGURES),
    "grounding_summary": (grounding_summary, GROUNDING_SUMMARY),
}
