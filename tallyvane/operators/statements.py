"""Statements and metrics: lines of accounts by borrower and year, figures read from tables, receivables, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import finance as M
from tallyvane.functions import text as X

# Labels of statement lines and the key that each is stored under.
LABELS = [
    ("revenue", "revenue"),
    ("cost of goods sold", "cogs"),
    ("gross profit", "gross_profit"),
    ("ebitda", "ebitda"),
    ("net income", "net_income"),
    ("interest expense", "interest"),
    ("income tax provision", "taxes"),
    ("depreciation and amortisation", "depreciation"),
    ("cash and cash equivalents", "cash"),
    ("accounts receivable, net", "accounts_receivable"),
    ("total current assets", "current_assets"),
    ("total current liabilities", "current_liabilities"),
    ("current portion of long-term debt", "current_portion_ltd"),
    ("long-term debt, net of current portion", "ltd_noncurrent"),
    ("total assets", "total_assets"),
    ("total equity", "total_equity"),
    ("capital expenditures", "capex"),
    ("repayment of long-term debt", "principal"),
    ("total accounts receivable", "total_receivables"),
    ("facility requested", "facility_requested"),
]


# What labels of percentages and of ratios hold.
PERCENT_LABELS = ["margin", "growth", "concentration", "%", "share", "change"]
RATIO_LABELS = ["ratio", "/ ebitda", "coverage", "dscr", "leverage"]


def identities(accounts: DataFrame) -> DataFrame:
    """Accounts (borrower, year and the stored lines, whole dollars) with the lines that follow from them."""
    order = Window.partitionBy("borrower").orderBy("year")
    c = F.col
    out = accounts.withColumns({"gross_profit": c("revenue") - c("cogs")}).withColumns({"ebitda": c("gross_profit") - c("opex")})
    out = out.withColumns({"ebit": c("ebitda") - c("depreciation")}).withColumns({"pretax_income": c("ebit") - c("interest")})
    out = out.withColumns({"net_income": c("pretax_income") - c("taxes"), "total_current_assets": c("cash") + c("receivables") + c("inventory")})
    out = out.withColumns(
        {
            "total_assets": c("total_current_assets") + c("fixed_assets"),
            "total_current_liabilities": c("payables") + c("current_portion"),
            "total_debt": c("current_portion") + c("long_term_debt"),
        }
    )
    out = out.withColumns({"total_liabilities": c("total_current_liabilities") + c("long_term_debt")})
    out = out.withColumns({"total_equity": c("total_assets") - c("total_liabilities")})
    working = lambda x: F.coalesce(c(x) - F.lag(x).over(order), F.lit(0))  # noqa: E731  none in the first year
    cash = c("net_income") + c("depreciation") - working("receivables") - working("inventory") + working("payables")
    return out.withColumns({"cfo": cash, "cfi": -c("capex"), "prior_revenue": F.lag("revenue").over(order)})


def metrics(accounts: DataFrame) -> DataFrame:
    """The twelve metrics of every borrower and year, from lines that identities() gives; and the recommendation they permit."""
    out = accounts.select(
        "borrower",
        "year",
        M.leverage("total_debt", "ebitda").alias("leverage"),
        M.dscr("ebitda", F.abs(F.col("capex")), F.abs(F.col("taxes")), F.abs(F.col("interest")), F.abs(F.col("principal"))).alias("dscr"),
        M.current_ratio("total_current_assets", "total_current_liabilities").alias("current_ratio"),
        M.margin("gross_profit", "revenue").alias("gross_margin"),
        M.margin("ebitda", "revenue").alias("ebitda_margin"),
        M.share_of("cogs", "revenue").alias("cogs_share"),
        M.interest_coverage("ebitda", "interest").alias("interest_coverage"),
        M.growth("revenue", "prior_revenue").alias("revenue_growth"),
    )
    return out.withColumn("required", M.required_recommendation("leverage", "dscr"))


def figure_rows(contexts: DataFrame) -> DataFrame:
    """Every row of a final document's context that a known label leads: deal, key, place and at (where it stands), series (its numeric
    cells, times the page's scale), document and page.

    contexts: deal, place, status, scale, document, page, rows (array of arrays of cells)."""
    labels = F.create_map(*(F.lit(x) for pair in LABELS for x in pair))
    rows = contexts.filter("status = 'final'").select("deal", "place", "scale", "document", "page", F.posexplode("rows").alias("at", "cells"))
    rows = rows.withColumn("key", labels[F.lower(F.trim(F.element_at("cells", 1)))]).filter("key IS NOT NULL")
    numbers = F.filter(F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: X.money(c)), lambda v: v.isNotNull())
    return rows.withColumn("series", F.transform(numbers, lambda v: v * F.col("scale"))).filter(F.size("series") > 0).drop("cells", "scale")


def first_figures(rows: DataFrame) -> DataFrame:
    """Of figure_rows() per deal and key the first, in order. The value is the row's last numeric cell, prior the one before."""
    order = Window.partitionBy("deal", "key").orderBy("place", "at")
    rows = rows.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return rows.select("deal", "key", F.element_at("series", -1).alias("value"), F.try_element_at("series", F.lit(-2)).alias("prior"), "series", "document", "page")


def extract_figures(contexts: DataFrame) -> DataFrame:
    """Figures of statement rows: per deal and key the first context, in order, with such a row of a final document."""
    return first_figures(figure_rows(contexts))


def with_priors(figures: DataFrame) -> DataFrame:
    """Figures, and as figures of their own what their rows say of earlier years: revenue and EBITDA of the year before, cash of the
    earliest year."""
    earlier = figures.filter("key IN ('revenue', 'ebitda') AND prior IS NOT NULL").select("deal", F.concat("key", F.lit(", prior year")).alias("key"), F.col("prior").alias("value"), "document", "page")
    cash = figures.filter("key = 'cash' AND prior IS NOT NULL").select("deal", F.lit("cash, earliest year").alias("key"), F.element_at("series", 1).alias("value"), "document", "page")
    return figures.select(earlier.columns).unionByName(earlier).unionByName(cash)


def receivables_book(contexts: DataFrame, top: int = 5) -> DataFrame:
    """Figures of receivables pages (deal, key, value, document, page): total receivables, over 90 days, largest customer, top five customers.

    Rows are told apart by what leads them, over all contexts of final documents named for ageing, as buckets and customers stand in
    tables, and so in chunks, of their own: totals and buckets by their words, customers by a share in the third cell."""
    named = F.lower("document").rlike("aging|ageing")
    own = contexts.filter((F.col("status") == "final") & named)
    rows = own.select("deal", "place", F.posexplode("rows").alias("at", "cells")).filter(F.size("cells") >= 2)
    head = F.lower(X.strip(F.element_at("cells", 1)))
    role = (
        F.when(head.startswith("total accounts receivable"), "total receivables")
        .when(head.startswith("over 90"), "over 90 days")
        .when(head.isin("current", "bucket", "customer") | head.rlike("^(31|61) ?-"), None)
        .when((F.size("cells") >= 3) & F.get("cells", F.lit(2)).endswith("%"), "customer")
    )
    rows = rows.select("deal", role.alias("role"), "place", "at", X.money(F.element_at("cells", 2)).alias("value")).filter("role IS NOT NULL AND value IS NOT NULL")
    stated = rows.filter("role <> 'customer'").groupBy("deal", F.col("role").alias("key")).agg(F.max_by("value", F.struct("place", "at")).alias("value"))
    ranked = rows.filter("role = 'customer'").withColumn("r", F.row_number().over(Window.partitionBy("deal").orderBy(F.desc("value"), "place", "at"))).filter(F.col("r") <= top)
    sums = ranked.groupBy("deal").agg(F.max("value").alias("a"), F.sum("value").alias("b"))
    owed = sums.selectExpr("deal", "stack(2, 'largest customer', a, 'top five customers', b) AS (key, value)")
    where = own.groupBy("deal").agg(F.min_by(F.struct("document", "page"), "place").alias("w"))
    return stated.unionByName(owed).join(where, "deal").select("deal", "key", "value", "w.document", "w.page")


#: Calculations of the log: name, unit, the figures that go in, and the value over columns of these.
CALCULATIONS = [
    ("total debt", "USD", ("current_portion_ltd", "ltd_noncurrent"), lambda a, b: M.total_debt(a, b)),
    ("leverage", "x", ("current_portion_ltd", "ltd_noncurrent", "ebitda"), lambda a, b, e: M.leverage(a + b, e)),
    ("debt service coverage", "x", ("ebitda", "capex", "taxes", "interest", "principal"), lambda e, *r: M.dscr(e, *(F.abs(x) for x in r))),
    ("current ratio", "x", ("current_assets", "current_liabilities"), lambda a, b: M.current_ratio(a, b)),
    ("gross margin", "percent", ("gross_profit", "revenue"), lambda a, b: M.margin(a, b)),
    ("EBITDA margin", "percent", ("ebitda", "revenue"), lambda a, b: M.margin(a, b)),
    ("net margin", "percent", ("net_income", "revenue"), lambda a, b: M.margin(a, b)),
    ("interest coverage", "x", ("ebitda", "interest"), lambda a, b: M.interest_coverage(a, b)),
    ("revenue growth", "percent", ("revenue", "revenue, prior year"), lambda a, b: M.change(a, b)),
    ("EBITDA growth", "percent", ("ebitda", "ebitda, prior year"), lambda a, b: M.change(a, b)),
    ("cash change over the period", "percent", ("cash", "cash, earliest year"), lambda a, b: M.change(a, b)),
    ("receivables over 90 days", "percent", ("over 90 days", "total receivables"), lambda a, b: M.share_of(a, b)),
    ("customer concentration", "percent", ("largest customer", "total receivables"), lambda a, b: M.concentration(a, b)),
    ("top five customer balances", "USD", ("top five customers",), lambda a: M.total(a)),
    ("top five customer concentration", "percent", ("top five customers", "total receivables"), lambda a, b: M.share_of(a, b)),
]


def calculation_log(figures: DataFrame) -> DataFrame:
    """Every calculation that a deal's figures (of extract_figures(), with_priors(), receivables_book()) support: deal, name, unit, value,
    inputs (key, value, document, page), the forms that it may be printed in, its inputs' distinct citations, and a line for the audit
    trail. What lacks an input or is undefined has no row."""
    held = figures.groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("value", "document", "page")))).alias("m"))  # one per key
    made = []
    for name, unit, keys, value in CALCULATIONS:
        inputs = F.array(*(F.struct(F.lit(k).alias("key"), F.col("m")[k]["value"].alias("value"), F.col("m")[k]["document"].alias("document"), F.col("m")[k]["page"].alias("page")) for k in keys))
        result = value(*(F.col("m")[k]["value"] for k in keys)).cast("double")
        made.append(F.when(result.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(unit).alias("unit"), result.alias("value"), inputs.alias("inputs"))))
    rows = held.select("deal", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c")).select("deal", "c.*")
    source = F.transform("inputs", lambda i: F.concat(i["key"], F.lit(" "), F.format_number(i["value"], 0), F.lit(" ["), i["document"], F.lit("#p"), i["page"].cast("string"), F.lit("]")))
    audit = F.concat("name", F.lit(" = "), M.formatted("value", "unit"), F.lit(" from "), F.array_join(source, "; "))
    cited = F.array_distinct(F.transform("inputs", lambda i: F.concat(F.lit("["), i["document"], F.lit("#p"), i["page"].cast("string"), F.lit("]"))))
    return rows.withColumns({"forms": derived_forms("value", "unit"), "citations": cited, "audit": audit})


def derived_forms(value, unit):
    """All forms in which a computed value may be printed: as formatted and with fewer places or marks; a percentage's size, too."""
    value, unit = F.col(value), F.col(unit)
    shown = M.formatted(value, unit)
    size = F.abs(value)
    percent = [X.fixed(v, places) for v in (value, size) for places in (1, 0)]
    more = (
        F.when(unit == "USD", F.array(F.format_number(value, 0), F.format_string("%d", value.cast("long"))))
        .when(unit == "percent", F.array(*percent, *(F.concat(p, F.lit("%")) for p in percent)))
        .when(unit == "x", F.array(F.concat(X.fixed(value, 1), F.lit("x")), X.fixed(value, 2), X.fixed(value, 1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(F.array(shown, F.regexp_replace(shown, r"^\$", "")), more))


def receivables(rows: DataFrame, top: int = 5) -> DataFrame:
    """Per deal: total owed, the largest customer's share, and the largest few's. rows: deal, customer, balance."""
    owed = rows.groupBy("deal", "customer").agg(F.sum("balance").alias("balance"))
    ranked = owed.withColumn("r", F.row_number().over(Window.partitionBy("deal").orderBy(F.desc("balance"), "customer")))
    sums = ranked.groupBy("deal").agg(F.sum("balance").alias("total"), F.max("balance").alias("largest"), F.min_by("customer", "r").alias("customer"), F.sum(F.when(F.col("r") <= top, F.col("balance"))).alias("top"))
    return sums.select("deal", "total", "customer", M.concentration("largest", "total").alias("concentration"), M.share_of("top", "total").alias("top_share"), (M.concentration("largest", "total") > M.CONCENTRATION_CONCERN).alias("concern"))


def identity_findings(figures: DataFrame) -> DataFrame:
    """Identities that figures (deal and one column per key) break by more than the tolerance; nulls are not checked."""
    a = lambda k: F.abs(F.col(k))
    off = lambda x, y: F.abs(x - y) > M.IDENTITY_TOLERANCE * F.greatest(F.abs(y), F.lit(1.0))
    checks = [
        ("revenue less cost of goods sold equals gross profit", a("revenue") - a("cogs"), a("gross_profit"), off(a("revenue") - a("cogs"), a("gross_profit"))),
        ("EBITDA cannot exceed gross profit", a("ebitda"), a("gross_profit"), a("ebitda") > a("gross_profit") * (1 + M.IDENTITY_TOLERANCE)),
        ("liabilities and equity equal assets", a("current_liabilities") + a("ltd_noncurrent") + a("total_equity"), a("total_assets"), off(a("current_liabilities") + a("ltd_noncurrent") + a("total_equity"), a("total_assets"))),
    ]
    found = F.array(*(F.when(broken, F.struct(F.lit(name).alias("identity"), left.cast("double").alias("left"), right.cast("double").alias("right"))) for name, left, right, broken in checks))
    return figures.select("deal", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("deal", "f.identity", "f.left", "f.right", (F.col("f.left") - F.col("f.right")).alias("gap"))


def derivations(operands: DataFrame) -> DataFrame:
    """Values that one step makes of a deal's operands (deal, ord, label, value, kind: USD, x or percent): each quoted, and for
    every pair of dollar values ratios, percentages, change, sum and differences. All operands count; memos have as many as there are labels and
    calculations."""
    quoted = operands.select("deal", F.col("ord").alias("i"), F.col("ord").alias("j"), "label", "value", "kind")
    usd = operands.filter("kind = 'USD'")
    a, b = (usd.select("deal", F.col("ord").alias(o), F.col("label").alias(n), F.col("value").alias(v)) for o, n, v in (("i", "x", "a"), ("j", "y", "b")))
    pairs = a.join(b, "deal").filter("i < j")
    made = """stack(8,
      concat(x, ' / ', y), CASE WHEN b <> 0 THEN a / b END, 'x', concat(y, ' / ', x), CASE WHEN a <> 0 THEN b / a END, 'x',
      concat(x, ' as a share of ', y), CASE WHEN b <> 0 THEN 100 * a / b END, 'percent', concat(y, ' as a share of ', x), CASE WHEN a <> 0 THEN 100 * b / a END, 'percent',
      concat('change from ', y, ' to ', x), CASE WHEN b <> 0 THEN 100 * (a - b) / abs(b) END, 'percent', concat(x, ' + ', y), a + b, 'USD',
      concat(x, ' - ', y), a - b, 'USD', concat(y, ' - ', x), b - a, 'USD') AS (label, value, kind)"""
    out = quoted.unionByName(pairs.selectExpr("deal", "i", "j", made).filter("value IS NOT NULL"))
    return out.unionByName(quoted.filter("value < 0").withColumns({"value": -F.col("value"), "label": F.concat(F.lit("magnitude of "), "label")}))


def pro_forma(operands: DataFrame) -> DataFrame:
    """Debt plus request, and its multiple of earnings, for every deal's triple of such operands (role: debt, request,
    earnings)."""
    parts = {r: operands.filter(F.col("role") == r).select("deal", F.col("ord").alias(f"{r}_ord"), F.col("value").alias(r)) for r in ("debt", "request", "earnings")}
    three = parts["debt"].join(parts["request"], "deal").filter("debt_ord <> request_ord").join(parts["earnings"], "deal")
    return three.selectExpr("deal", "debt_ord AS i", "request_ord AS j", "stack(2, 'pro forma debt', debt + request, 'USD', 'pro forma leverage', CASE WHEN earnings > 0 THEN (debt + request) / earnings END, 'x') AS (label, value, kind)").filter("value IS NOT NULL")


def rounded_units(value, places) -> Column:
    """A number in units of its last place, rounded as X.fixed() prints it: where it all but lies between two, a product would decide by its own
    rounding."""
    near = value * F.pow(F.lit(10.0), places)
    between = F.abs(F.abs(near - F.floor(near)) - 0.5) < 1e-6
    exact = F.regexp_replace(F.call_function("format_number", value, places), "[^0-9-]", "").try_cast("double")
    return F.when(between, exact).otherwise(F.rint(near))


def printed_as(figure: str, value: str, kind: str):
    """Whether a figure as printed shows a value, rounded or cut at its own places, sign included; dollars also in thousands and
    millions. Fewer than three significant digits, zeros at either end left out, prove nothing; a printed zero shows a value of zero, whatever
    its kind."""
    figure_, value_ = F.col(figure), F.col(value)
    digits = F.regexp_replace(F.regexp_replace(figure_, "[^0-9]", ""), "^0+", "")
    shown = F.regexp_replace(figure_, "[^0-9.-]", "").try_cast("decimal(30,6)").cast("double")
    places = F.greatest(F.length(F.regexp_extract(figure_, r"\.(\d+)", 1)), F.lit(0))
    own_kind = F.when(figure_.endswith("%"), "percent").when(figure_.endswith("x"), "x").otherwise("USD")
    step = F.pow(F.lit(10.0), -places)

    def near(target):
        cut = F.signum(target) * F.floor(F.abs(target) / step + 1e-9) * step
        rounded = rounded_units(target, places) * step
        return (F.abs(cut - shown) < step / 1e3) | (F.abs(rounded - shown) < step / 1e3)

    scaled = near(value_) | ((own_kind == "USD") & (near(value_ / 1e3) | near(value_ / 1e6)))
    cut_off = F.length(F.regexp_replace(digits, "0+$", ""))
    significant = F.when(cut_off > 0, cut_off).otherwise(F.length(digits)) >= 3
    return F.coalesce(F.when(shown == 0, F.abs(value_) < 1e-9).otherwise(significant & (own_kind == F.col(kind)) & scaled), F.lit(False))


#: Decimal places that a printed figure is read to.
PLACES = 6


def printed_keys(figures: DataFrame) -> DataFrame:
    """Figures with what a value that they show must equal: kind (by their mark: percent, x or USD; zero for a printed zero), places and n
    (the figure in units of its last place). Fewer than three significant digits, zeros at either end left out, prove nothing: such
    figures are left out."""
    f = F.col("figure")
    digits = F.regexp_replace(F.regexp_replace(f, "[^0-9]", ""), "^0+", "")
    shown = F.regexp_replace(f, "[^0-9.-]", "").try_cast(f"decimal(30,{PLACES})").cast("double")
    places = F.least(F.length(F.regexp_extract(f, r"\.(\d+)", 1)), F.lit(PLACES))
    kind = F.when(shown == 0, "zero").when(f.endswith("%"), "percent").when(f.endswith("x"), "x").otherwise("USD")
    cut_off = F.length(F.regexp_replace(digits, "0+$", ""))
    significant = F.when(cut_off > 0, cut_off).otherwise(F.length(digits)) >= 3
    rows = figures.withColumns({"kind": kind, "places": F.when(shown == 0, 0).otherwise(places), "significant": significant | (shown == 0)})
    return rows.withColumn("n", F.rint(shown * F.pow(F.lit(10.0), F.col("places")))).filter("significant AND n IS NOT NULL").drop("significant")


def shows(value, n, places, kind):
    """Whether n, a figure in units of its last place, can show a value: rounded, or cut, at those places, sign included; dollars also in
    thousands and millions."""
    unit = F.pow(F.lit(10.0), places)

    def by(size):
        x = value / size
        # Only what lies within a unit is rounded.
        near = F.abs(x * unit - n) <= 1 + F.abs(n) * 1e-9
        return near & ((rounded_units(x, places) == n) | (F.signum(x) * F.floor(F.abs(x) * unit + 1e-9) == n))

    return by(F.lit(1.0)) | (kind == "USD") & (by(F.lit(1e3)) | by(F.lit(1e6)))


def kind_of(label):
    """What a line of accounts is measured in, by its label: percent, x (a ratio) or USD."""
    low = F.lower(F.col(label) if isinstance(label, str) else label)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.when(has(PERCENT_LABELS), "percent").when(has(RATIO_LABELS), "x").otherwise("USD")


def explained(figures: DataFrame, derived: DataFrame) -> DataFrame:
    """Each figure (deal, place, figure) with the first derivation that prints as it does, or null. A printed zero shows values of zero, of whatever
    kind."""
    keys = printed_keys(figures.select("deal", "place", "figure"))
    values = derived.select("deal", "i", "j", "label", "value", "kind")
    hits = keys.join(values, ["deal", "kind"]).filter(shows(F.col("value"), F.col("n"), F.col("places"), F.col("kind"))).select("deal", "place", "i", "j", "label")
    nothing = keys.filter("kind = 'zero'").select("deal", "place").join(values.filter(F.abs("value") < 1e-9).select("deal", "i", "j", "label"), "deal")
    hits = hits.unionByName(nothing)
    first = hits.groupBy("deal", "place").agg(F.min_by("label", F.struct("i", "j", "label")).alias("derivation"))
    return figures.join(first, ["deal", "place"], "left")
