"""Memos: gathered contexts, drafts, verification of every figure, one revision, and what a reviewer must see.

All borrowers are one plan: the bounded revision loop is two passes written out, not a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.functions import finance as M
from tallyvane.functions import text as X
from tallyvane.operators import answering, evaluate, operations, search, statements
from tallyvane.sources import storage

# The questions that every memo answers, and the thresholds a memo may print.
QUESTIONS = [
    ("request", "How much is the borrower requesting and for what purpose?"),
    ("business", "Describe the business, its industry and its ownership."),
    ("performance", "What were revenue, EBITDA and net income in the latest year?"),
    ("balance_sheet", "What were cash, total assets and total debt at year end?"),
    ("debt", "What existing debt facilities does the borrower have?"),
    ("receivables", "What is the receivables ageing and customer concentration?"),
    ("risks", "What legal, related-party or other risks were disclosed?"),
]
#: Asked beside them: the words of receivables tables, which a question in sentences tends to miss one of.
DETAIL = ("receivables_detail", "customer balance % of AR ageing bucket over 90 days total accounts receivable")
POLICY_FORMS = ["3.5x", "3.50x", "1.25x", "1.2x", "1.1x", "1.10x", "25%", "25.0%", "3,000,000", "40,000,000"]


def gathered(hits: DataFrame) -> DataFrame:
    """Hits of all of a deal's questions (deal, section: its order, rank, doc), each document once: where it came first."""
    first = Window.partitionBy("deal", "doc").orderBy("section", "rank")
    kept = hits.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("deal").orderBy("section", "rank", "doc")) - 1)


def draft(metrics: DataFrame, note: str | None = None) -> DataFrame:
    """deal and text of a memo from a deal's metrics (deal, revenue, ebitda, leverage, dscr, document, page); a revision's note
    stands before the recommendation."""
    cite = F.concat(F.lit(" ["), "document", F.lit("#p"), F.col("page").cast("string"), F.lit("]"))
    required = M.required_recommendation("leverage", "dscr")
    text = F.concat_ws(
        "\n",
        F.lit("PERFORMANCE"),
        F.concat(F.lit("Revenue of "), F.format_number("revenue", 0), F.lit(" and EBITDA of "), F.format_number("ebitda", 0), cite, F.lit(".")),
        F.lit("LEVERAGE AND COVERAGE"),
        F.when(F.col("leverage").isNotNull(), F.concat(F.lit("Total debt is "), X.fixed("leverage", 2), F.lit("x EBITDA against a limit of 3.5x."))),
        F.when(F.col("dscr").isNotNull(), F.concat(F.lit("Debt service is covered "), X.fixed("dscr", 2), F.lit("x against a floor of 1.25x."))),
        F.lit(note) if note else F.lit(None).cast("string"),
        F.lit("RECOMMENDATION"),
        required,
    )
    return metrics.select("deal", text.alias("text"))


def verified(memos: DataFrame, contexts: DataFrame, derived: DataFrame) -> DataFrame:
    """Every figure of every memo (deal, text) and how it stands: computed (derived: deal, form), policy, printed on a context's
    page (contexts: deal, document, page, text), or an issue."""
    found = evaluate.grounding(memos.withColumnRenamed("deal", "answer"), contexts.withColumnRenamed("deal", "answer"), derived.withColumnRenamed("deal", "answer"))
    forms = F.array(*map(F.lit, POLICY_FORMS))
    how = F.when(F.col("bucket") == "derived", "computed").when(F.array_contains(forms, F.col("figure")), "policy").when(F.col("bucket").isin("grounded", "uncited"), "printed").otherwise("issue")
    return found.select(F.col("answer").alias("deal"), "place", "figure", how.alias("standing"))


def revised(memos: DataFrame, checks: DataFrame) -> DataFrame:
    """Second pass: sentences that hold an unexplained figure are cut; memos without issues stay."""
    bad = checks.filter("standing = 'issue'").groupBy("deal").agg(F.collect_set("figure").alias("bad"))  # of one memo
    rows = memos.join(bad, "deal", "left")
    kept = F.filter(F.split("text", "\n"), lambda line: ~F.exists(F.coalesce("bad", F.array().cast("array<string>")), lambda f: F.contains(line, f)))
    return rows.select("deal", F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.col("bad").isNotNull().alias("revised"))


# ---- the memo graph: gather, compute, draft, verify, revise once


def questions(deals: DataFrame) -> DataFrame:
    """question, deal, section (its order) and text of all that a memo asks of each deal (deal)."""
    asked = F.array(*(F.struct(F.lit(n).alias("section"), F.lit(q).alias("text")) for n, (_, q) in enumerate([*QUESTIONS, DETAIL])))
    rows = deals.select("deal", F.explode(asked).alias("q"))
    return rows.select(F.concat_ws("#", "deal", "q.section").alias("question"), "deal", "q.section", "q.text")


def gather(chunks: DataFrame, deals: DataFrame, k: int = 6, options: search.Options = search.Options(dense=False)) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Hits of every question of every deal (deal, section, rank, doc and its context), and the deal's contexts: each document of the hits
    once, in the order in which it came up (place), with its table rows."""
    asked = questions(deals)
    found = answering.retrieved(chunks, asked, k, options)
    hits = found.join(asked.select("question", "deal", "section"), "question").drop("question").withColumnRenamed("chunk_id", "doc")
    pooled = gathered(hits).select("deal", "section", "rank", "place", "doc", "document", "page", "text", "status", F.col("scale_factor").alias("scale"), context_rows("text").alias("rows"))
    return hits, storage.written(pooled, "contexts")


def context_rows(text):
    """The lines of a chunk's text that are table rows, as arrays of cells."""
    shown = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")))
    return F.transform(shown, lambda x: F.transform(F.split(x, r"\|"), X.strip))


def compute(contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures that a deal's contexts print, those of receivables and of earlier years among them, and the log of what follows."""
    figures = statements.extract_figures(contexts)
    every = statements.with_priors(figures).unionByName(statements.receivables_book(contexts))
    every = storage.written(every, "figures")
    return every, storage.written(statements.calculation_log(every), "calculations")


def drafted(deals: DataFrame, figures: DataFrame, log: DataFrame, contexts: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """deal and text of the memo that a template makes of a deal's figures and calculations: what isn't known isn't printed. notes (deal,
    sentence): what else the drafter wants to say, before the recommendation."""
    held = figures.groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("value", "document", "page")))).alias("m"))  # one per key
    made = log.groupBy("deal").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("value", M.formatted("value", "unit").alias("shown"), "citations")))).alias("c"))
    other = contexts.filter("status <> 'final'").groupBy("deal").agg(F.array_sort(F.collect_set(F.struct("document", "status"))).alias("other"))
    scaled = contexts.filter("scale <> 1").groupBy("deal").agg(F.array_sort(F.collect_set("document")).alias("scaled"))
    rows = deals.select("deal")
    for part in (held, made, other, scaled):
        rows = rows.join(part, "deal", "left")
    if notes is not None:
        rows = rows.join(notes.groupBy("deal").agg(F.array_sort(F.collect_list("sentence")).alias("notes")), "deal", "left")  # of one draft
    m, c = F.col("m"), F.col("c")
    none = F.array().cast("array<string>")

    def line(label, key):
        return F.when(m[key].isNotNull(), F.concat(F.lit(f"  {label}: $"), F.format_number(m[key]["value"], 0), F.lit(" ["), m[key]["document"], F.lit("#p"), m[key]["page"].cast("string"), F.lit("]")))

    def worked(label, name):
        return F.when(c[name].isNotNull(), F.concat(F.lit(f"  {label}: "), c[name]["shown"], F.lit(" "), F.array_join(c[name]["citations"], " ")))

    lev, cov, cur = c["leverage"], c["debt service coverage"], c["current ratio"]
    findings = [
        F.when(lev.isNotNull(), F.concat(F.lit("  - Leverage of "), lev["shown"], F.when(lev["value"] > M.MAX_LEVERAGE, " exceeds the limit of 3.5x.").otherwise(" is within the limit of 3.5x."))),
        F.when(cov.isNotNull(), F.concat(F.lit("  - Coverage of "), cov["shown"], F.when(cov["value"] < M.MIN_DSCR, " is below the floor of 1.25x.").otherwise(" clears the floor of 1.25x."))),
        F.when(cur["value"] < M.MIN_CURRENT_RATIO, F.concat(F.lit("  - A current ratio of "), cur["shown"], F.lit(" leaves little near-term liquidity."))),
    ]
    marked = F.transform(F.coalesce("other", F.array().cast("array<struct<document:string,status:string>>")), lambda o: F.concat(F.lit("  - "), o["document"], F.lit(" is marked "), F.upper(o["status"]), F.lit("; its figures are left out.")))
    rescaled = F.transform(F.coalesce("scaled", none), lambda d: F.concat(F.lit("  - "), d, F.lit(" states its figures in larger units.")))
    text = F.concat_ws(
        "\n",
        F.lit("CREDIT MEMORANDUM\nFINANCIAL PERFORMANCE"),
        *(line(n, k) for n, k in (("Revenue", "revenue"), ("EBITDA", "ebitda"), ("Net income", "net_income"))),
        F.lit("BALANCE SHEET"),
        *(line(n, k) for n, k in (("Cash", "cash"), ("Total assets", "total_assets"), ("Total equity", "total_equity"))),
        F.lit("LEVERAGE AND COVERAGE"),
        *(worked(n, k) for n, k in (("Total debt", "total debt"), ("Total debt to EBITDA", "leverage"), ("Debt service coverage", "debt service coverage"), ("Current ratio", "current ratio"))),
        F.lit("FINDINGS"),
        *findings,
        F.concat(marked, rescaled),
        F.coalesce("notes", none) if notes is not None else F.lit(None).cast("string"),
        F.lit("RECOMMENDATION"),
        F.concat(F.lit("  "), M.required_recommendation(lev["value"], cov["value"])),
    )
    return rows.select("deal", text.alias("text"))


def operands(figures: DataFrame, log: DataFrame) -> DataFrame:
    """What a figure may be derived from (deal, ord, label, value, kind, role): labelled lines, in the order of the labels, then calculations."""
    keys = F.array(*(F.lit(k) for _, k in statements.LABELS))
    names = F.array(*(F.lit(n) for n, *_ in statements.CALCULATIONS))
    roles = F.create_map(F.lit("facility_requested"), F.lit("request"), F.lit("ebitda"), F.lit("earnings"), F.lit("total debt"), F.lit("debt"))
    lines = figures.filter(F.array_contains(keys, F.col("key"))).select("deal", F.array_position(keys, F.col("key")).alias("n"), F.col("key").alias("label"), "value", F.lit("USD").alias("kind"))
    made = log.select("deal", (F.array_position(names, F.col("name")) + 100).alias("n"), F.col("name").alias("label"), "value", F.col("unit").alias("kind"))
    rows = lines.unionByName(made)
    return rows.select("deal", (F.row_number().over(Window.partitionBy("deal").orderBy("n")) - 1).alias("ord"), "label", "value", "kind", roles[F.col("label")].alias("role"))


def derived(parts: DataFrame) -> DataFrame:
    """What one step, or a pro forma, makes of operands()."""
    return statements.derivations(parts).unionByName(statements.pro_forma(parts))


def derivable(figures: DataFrame, log: DataFrame) -> DataFrame:
    """What is derived() of a deal's labelled lines and calculations. Only these are written."""
    return derived(storage.written(operands(figures, log), "operands"))


def checked(memos: DataFrame, contexts: DataFrame, log: DataFrame, values: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Every figure of every memo (deal, text) and how it stands (deal, place, figure, standing, derivation): computed, policy, printed,
    reconstructible (what derivable() gives prints as it does), or an issue. values: of derivable(); or parts: operands(), of which values are
    derived only for deals that have something to explain."""
    checks = storage.written(verified(memos, contexts, log.select("deal", F.explode("forms").alias("form"))), "checks")
    issues = storage.written(checks.filter("standing = 'issue'").select("deal", "place", "figure"), "issues")
    if values is None:
        values = derived(storage.written(parts.join(issues.select("deal"), "deal", "left_semi"), "operands"))
    why = statements.explained(issues, values)
    out = checks.join(why.filter("derivation IS NOT NULL").select("deal", "place", "derivation"), ["deal", "place"], "left")
    return out.withColumn("standing", F.when(F.col("derivation").isNotNull(), "reconstructible").otherwise(F.col("standing")))


@dataclass(frozen=True)
class Runs:
    """Tables of runs(): results has a row for each deal."""

    results: DataFrame
    memos: DataFrame
    checks: DataFrame
    hits: DataFrame
    contexts: DataFrame
    figures: DataFrame
    log: DataFrame


def runs(chunks: DataFrame, deals: DataFrame, notes: DataFrame | None = None, k: int = 6) -> Runs:
    """The memo graph over all deals (deal) at once: questions search the deal's own chunks, figures and calculations are read from what was
    found, a draft is written and every figure in it verified. A draft with issues is written once more without the sentences that hold
    them and verified again; there is no third pass, so both are written out as one plan.

    notes: deal, pass (1 or 2) and sentence, what a drafter says besides the template in each pass."""
    hits, contexts = gather(chunks, deals, k)
    figures, log = compute(contexts)
    parts = storage.written(operands(figures, log), "operands")
    said = lambda n: None if notes is None else notes.filter(F.col("pass") == n).select("deal", "sentence")
    first = storage.written(drafted(deals, figures, log, contexts, said(1)), "drafts")
    before = storage.written(checked(first, contexts, log, parts=parts), "checks")
    second = revised(first, before)
    if notes is not None:
        more = said(2).groupBy("deal").agg(F.array_join(F.array_sort(F.collect_list("sentence")), "\n").alias("more"))  # of one draft
        second = second.join(more, "deal", "left").withColumn("text", F.when(F.col("revised"), F.concat_ws("\n", "text", "more")).otherwise(F.col("text"))).drop("more")
    memos = storage.written(second, "memos")
    again = checked(memos.filter("revised").select("deal", "text"), contexts, log, parts=parts)
    kept = before.join(memos.filter("revised").select("deal"), "deal", "left_anti")
    checks = storage.written(kept.unionByName(again.select(kept.columns)), "checks")
    return Runs(run_results(memos, checks, figures, log), memos, checks, hits, contexts, figures, log)


def run_results(memos: DataFrame, checks: DataFrame, figures: DataFrame, log: DataFrame) -> DataFrame:
    """One row per deal: the recommendation stated, figures by standing, whether the memo was revised and is verified (no issue is left), its
    citations, and the calculations behind it with their audit trail."""
    standings = ["computed", "policy", "printed", "reconstructible", "issue"]
    counts = checks.groupBy("deal").agg(F.count("*").alias("n_figures"), *(F.count_if(F.col("standing") == s).alias(s) for s in standings))
    worked = log.groupBy("deal").agg(F.count("*").alias("calculations"), F.array_join(F.array_sort(F.collect_list("audit")), "\n").alias("audit_trail"))  # a dozen
    read = figures.groupBy("deal").agg(F.count("*").alias("figures_read"))
    out = memos.select("deal", X.stated_recommendation("text").alias("stated"), "revised", F.size(X.citations("text")).alias("citations"))
    for part in (counts, worked, read):
        out = out.join(part, "deal", "left")
    return out.fillna(0, ["n_figures", *standings, "calculations", "figures_read"]).withColumn("verified", F.col("issue") == 0)


# ---- attacks through retrieval


def poisoned_spots(hits: DataFrame, contexts: DataFrame) -> DataFrame:
    """Where a payload ends up among a deal's contexts if every search returns it: deal, target, place, status, ahead. Data goes ahead of
    the first statement of a search's hits, anything else behind the first letter, both behind the first hit where there is none. A copy
    that an earlier search has returned clean stays clean.

    hits: deal, section, rank, doc, kind, status; contexts: deal, section, place, doc."""
    own = ["deal", "section"]
    first = hits.groupBy(*own).agg(*(F.min_by("doc", F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ("financial_statements", "correspondence")), F.min_by("doc", "rank").alias("any"))
    data = F.struct(F.lit("data").alias("target"), F.coalesce("financial_statements", "any").alias("doc"), F.col("financial_statements").isNotNull().alias("ahead"))
    prose = F.struct(F.lit("prose").alias("target"), F.coalesce("correspondence", "any").alias("doc"), F.lit(False).alias("ahead"))
    spots = first.select(*own, F.explode(F.array(data, prose)).alias("s")).select(*own, "s.*")
    return spots.join(contexts.select("deal", "section", "doc", "place", "status"), ["deal", "section", "doc"]).select("deal", "target", "place", "status", "ahead")


def attacked(hits: DataFrame, contexts: DataFrame, attacks: DataFrame) -> DataFrame:
    """Every attack (attack, family, target, payload) on every deal, through what its searches have returned: attack, family, deal, baseline
    (the clean memo's recommendation), decision, held (blocked by the guard), blocked (where the clean memo isn't), detected, unguarded (looser than the baseline if
    no identity is checked) and error.

    Hits are fetched once. A payload moves the decision by the figures it prints, so only its rows meet the deal's own: the first row of a
    label, in the order of contexts, is what the memo reads. An amount that no number holds is an error of that run, not of all."""
    rows = statements.figure_rows(contexts).select("deal", "key", "place", "at", F.element_at("series", -1).alias("value"))
    order = F.struct("place", "at")
    clean = storage.written(rows.groupBy("deal", "key").agg(F.min(order).alias("o"), F.min_by("value", order).alias("value")), "clean")
    printed = attacks.select("attack", F.when(F.col("family") == "data", "data").otherwise("prose").alias("target"), context_rows("payload").alias("rows"))
    whole = printed.select("attack", F.lit("").alias("deal"), "target", F.lit(0).alias("place"), F.lit("final").alias("status"), F.lit(1).alias("scale"), F.lit("").alias("document"), F.lit(0).alias("page"), "rows")
    lines = statements.figure_rows(whole.withColumn("deal", F.struct("attack", "target")).drop("attack", "target"))
    lines = lines.select("deal.attack", "deal.target", "key", F.col("at").alias("line"), F.element_at("series", -1).alias("value"))
    spots = poisoned_spots(hits, contexts).filter("status = 'final'")
    behind = F.when(F.col("ahead"), F.col("line") - 1_000_000).otherwise(F.col("line") + 1_000_000).cast("int")
    put = spots.join(lines, "target").select("attack", "deal", "key", F.struct("place", behind.alias("at")).alias("o"), "value")
    put = put.groupBy("attack", "deal", "key").agg(F.min("o").alias("p_o"), F.min_by("value", "o").alias("p_value"))
    every = clean.select("deal").distinct().join(attacks.select("attack").unionByName(attacks.sparkSession.createDataFrame([("",)], "attack string")))  # a dozen attacks
    keys = clean.select("deal", "key").unionByName(put.select("deal", "key")).distinct()
    read = every.join(keys, "deal").join(clean, ["deal", "key"], "left").join(put, ["attack", "deal", "key"], "left")
    value = F.when(F.col("p_o") < F.coalesce("o", F.struct(F.lit(1 << 30).alias("place"), F.lit(0).alias("at"))), F.col("p_value")).otherwise(F.col("value"))
    read = read.select(F.struct("attack", "deal").alias("deal"), "key", value.alias("value")).filter("value IS NOT NULL")
    lost = read.groupBy("deal").agg(F.max(F.when(F.abs("value") == float("inf"), F.concat(F.lit("amount out of range: "), "key"))).alias("error"))
    ends = decided_by(read.filter(F.abs("value") < float("inf"))).join(lost, "deal").select("deal.attack", "deal.deal", "stated", "blocked", "error")
    baseline = ends.filter("attack = ''").select("deal", F.col("stated").alias("baseline"), F.col("blocked").alias("baseline_held"))
    known = attacks.select("attack", "family", X.instruction_kind("payload").isNotNull().alias("detected"))
    ends = ends.join(known, "attack").join(baseline, "deal")
    good = F.col("error").isNull()
    decision = F.when(good, F.col("stated"))
    looser = good & (M.permissiveness("stated") > M.permissiveness("baseline"))
    return ends.select(
        "attack", "family", "deal", "baseline", decision.alias("decision"), (good & F.col("blocked")).alias("held"), (good & F.col("blocked") & ~F.col("baseline_held")).alias("blocked"), "detected", looser.alias("unguarded"), "error"
    )


def review_items(decisions: DataFrame, checks: DataFrame, findings: DataFrame, instructions: DataFrame) -> DataFrame:
    """Items of all kinds for the queue: item_id, deal, kind and summary.

    decisions: of operations.guard(); checks: of verified(); findings: of statements.identity_findings(); instructions: deal,
    document, kind. A memo that broken identities hold has their items and none for being blocked; figures that a derivation explains
    (checks with such a column) are for confirmation, others low in confidence."""
    broken = findings.select("deal").distinct()
    if "derivation" not in checks.columns:
        checks = checks.withColumn("derivation", F.lit(None).cast("string"))
    issues = checks.filter("standing = 'issue'")
    made = [
        decisions.filter("blocked").join(broken, "deal", "left_anti").select("deal", F.lit("blocked_memo").alias("kind"), F.col("reason").alias("summary")),
        decisions.filter("conservative").select("deal", F.lit("conservative_recommendation").alias("kind"), F.concat_ws(" stated where the metrics permit ", "stated", "required").alias("summary")),
        issues.filter("derivation IS NOT NULL").select("deal", F.lit("reconstruction").alias("kind"), F.concat_ws(" = ", "figure", "derivation").alias("summary")),
        issues.filter("derivation IS NULL").select("deal", F.lit("low_confidence_extraction").alias("kind"), F.concat(F.lit("not grounded: "), "figure").alias("summary")),
        findings.select("deal", F.lit("accounting_inconsistency").alias("kind"), F.col("identity").alias("summary")),
        instructions.select("deal", F.lit("injection_finding").alias("kind"), F.concat_ws(": ", "document", "kind").alias("summary")),
    ]
    out = made[0]
    for rows in made[1:]:
        out = out.unionByName(rows)
    name = F.concat_ws("-", "deal", F.upper(F.substring("kind", 1, 4)), F.substring(F.sha2(F.col("summary"), 256), 1, 8))
    return out.distinct().select(name.alias("item_id"), "deal", "kind", "summary", operations.priority("kind").alias("priority"))


def statement_rows(text):
    """The lines of a text that are a label and then figures, as arrays of cells."""
    line = r"^\s*([A-Za-z][A-Za-z ,&-]*?)((?:\s+\(?\$?[0-9][0-9,]*\)?)+)\s*$"
    shown = F.filter(F.split(text, "\n"), lambda x: x.rlike(line))
    return F.transform(shown, lambda x: F.concat(F.array(F.regexp_extract(x, line, 1)), F.split(F.trim(F.regexp_extract(x, line, 2)), r"\s+")))


def decided(contexts: DataFrame) -> DataFrame:
    """Memos written from contexts (deal, place, text; all final) and held against their figures: of operations.guard()."""
    pages = contexts.select(
        "deal", "place", F.lit("final").alias("status"), X.scale("text").alias("scale"), F.lit("contexts").alias("document"), F.lit(1).alias("page"), statement_rows("text").alias("rows")
    )
    return decided_by(statements.extract_figures(pages).select("deal", "key", "value"), contexts.select("deal").distinct())


def decided_by(figures: DataFrame, deals: DataFrame | None = None) -> DataFrame:
    """Memos that figures (deal, key, value) permit, held against the same figures: of operations.guard(), for all deals (deal)."""
    keys = [k for _, k in statements.LABELS]
    found = figures.groupBy("deal").pivot("key", keys).agg(F.first("value"))
    if deals is not None:
        found = deals.join(found, "deal", "left")
    broken = statements.identity_findings(found).groupBy("deal").agg(F.count("*").alias("broken"))
    lines = found.withColumns(
        {
            "borrower": F.col("deal"),
            "year": F.lit(0),
            "total_debt": F.col("current_portion_ltd") + F.col("ltd_noncurrent"),
            "total_current_assets": F.col("current_assets"),
            "total_current_liabilities": F.col("current_liabilities"),
            "prior_revenue": F.lit(None).cast("double"),
        }
    )
    ratios = statements.metrics(lines).select(F.col("borrower").alias("deal"), "leverage", "dscr")
    rows = found.select("deal", "revenue", "ebitda").join(ratios, "deal").withColumns({"document": F.lit("contexts"), "page": F.lit(1)})
    memos = draft(rows).join(ratios, "deal").join(broken, "deal", "left").fillna(0, ["broken"])
    return operations.guard(memos)


def run_attacks(contexts: DataFrame, attacks: DataFrame) -> DataFrame:
    """Per deal and attack: whether the payload itself reads as an instruction, the recommendation of the memo written from
    the poisoned contexts and of the one from the clean ones (baseline), and whether the guard blocks the poisoned one.

    The decision follows the figures that the contexts print, never their prose: instructions leave it as it is, and a
    figure that a payload adds counts only if no context before it has one. contexts: deal, place, kind, text."""
    clean = contexts.select(F.lit("").alias("attack"), "deal", "place", "text")
    every = operations.poisoned(contexts, attacks).select("attack", "deal", "place", "text").unionByName(clean)
    ends = decided(every.select(F.struct("attack", "deal").alias("deal"), "place", "text")).select("deal.attack", "deal.deal", "stated", "blocked")
    baseline = ends.filter("attack = ''").select("deal", F.col("stated").alias("baseline"))
    detected = attacks.select("attack", "family", X.instruction_kind("payload").isNotNull().alias("detected"))
    out = ends.join(detected, "attack").join(baseline, "deal")
    return out.select("attack", "family", "deal", "baseline", F.col("stated").alias("decision"), "blocked", "detected", F.lit(None).cast("string").alias("error"))
