"""Queries of guard decisions, ledgers, gates, reviews, answering and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyvane.operators import evaluate, operations, statements
from tallyvane.plans import finance_queries, search_queries
from tallyvane.sources import storage, tables
from tallyvane.streaming import logs

BUDGET = 0.5


def call_ledger(spark, sf_dir):
    """Events as model calls of users under a budget each: calls, dollars, and calls that were no longer affordable."""
    events = tables.table(spark, sf_dir, "events")
    tier = F.when(F.col("event_type") == "purchase", "large").when(F.col("event_type").isin("error", "signup"), "medium").otherwise("small")
    calls = events.select("user_id", F.col("event_id").alias("ord"), tier.alias("model"), (F.col("event_id") % 5000 + 100).alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"))
    prices = spark.createDataFrame(operations.PRICES, "model string, input_price double, output_price double")
    spent = operations.ledger(calls, prices, BUDGET, "user_id")
    return spent.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.count_if(~F.col("affordable")).alias("refused"), F.round(F.min("remaining"), 6).alias("least_remaining"))


#: The same fold, call by call, by recursion: a refused call spends nothing.
CALL_LEDGER = f"""
WITH RECURSIVE c AS (
  SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 15.0 WHEN event_type IN ('error', 'signup') THEN 3.0 ELSE 1.0 END AS i, event_id % 5000 + 100 AS a, CAST(floor(value * 10) AS BIGINT) AS b FROM events
), p AS MATERIALIZED (SELECT user_id, (a * CAST(i AS DOUBLE) + b * (CAST(i AS DOUBLE) * 5)) / 1000000 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM c
), s AS (
  SELECT user_id, k, cost, 0.0::DOUBLE AS spent, cost <= {BUDGET} AS made FROM p WHERE k = 1
  UNION ALL SELECT p.user_id, p.k, p.cost, CASE WHEN s.made THEN s.spent + s.cost ELSE s.spent END, CASE WHEN s.made THEN s.spent + s.cost ELSE s.spent END + p.cost <= {BUDGET} FROM s JOIN p ON p.user_id = s.user_id AND p.k = s.k + 1
)
SELECT user_id, count(*) AS calls, round(sum(cost), 6) AS cost, count(*) FILTER (NOT made) AS refused, round(min(greatest(0, {BUDGET} - spent)), 6) AS least_remaining FROM s GROUP BY user_id"""

_KINDS = list(operations.PRIORITY)


def _review(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("user_id") % 6 + 1).cast("int"))
    items = events.select(F.col("user_id").alias("item_id"), (F.col("user_id") % 20).alias("deal"), kind.alias("kind")).distinct()
    decision = F.when(F.col("event_type").isin("click", "signup"), "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "escalated").otherwise("pending")
    log = events.select(F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), decision.alias("decision"), F.when(F.col("value") >= 5, F.lit("analyst")).alias("reviewer"))
    return operations.review_state(items, log)


def review_queue(spark, sf_dir):
    """Every review item with its latest valid decision."""
    return _review(spark, sf_dir).withColumn("decided_at", F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss"))


REVIEW_QUEUE = f"""
WITH items AS (SELECT DISTINCT user_id AS item_id, user_id % 20 AS deal, [{", ".join(f"'{k}'" for k in _KINDS)}][user_id % 6 + 1] AS kind FROM events),
log AS (
  SELECT user_id AS item_id, ts, CASE WHEN event_type IN ('click', 'signup') THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'purchase' THEN 'escalated' ELSE 'pending' END AS decision,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value >= 5 AND event_type <> 'view'
)
SELECT item_id, deal, kind, coalesce(decision, 'pending') AS decision, CASE WHEN decision IS NOT NULL THEN 'analyst' END AS reviewer, strftime(ts, '%Y-%m-%d %H:%M:%S') AS decided_at,
  CAST(list_position([{", ".join(f"'{k}'" for k in _KINDS)}], kind) - 1 AS INTEGER) AS priority, kind IN ('blocked_memo', 'accounting_inconsistency') AS blocking
FROM items LEFT JOIN (SELECT * FROM log WHERE r = 1) USING (item_id)"""


def releasable_deals(spark, sf_dir):
    return operations.releasable(_review(spark, sf_dir))


RELEASABLE_DEALS = f"""
SELECT deal, count(*) AS items, count(*) FILTER (decision = 'pending') AS pending, count(*) FILTER (blocking AND decision = 'pending') = 0 AS releasable
FROM ({REVIEW_QUEUE}) GROUP BY deal"""


def guard_decisions(spark, sf_dir):
    """Memos of every borrower and year that recommend by year, held against the metrics and identities."""
    full = statements.metrics(statements.identities(finance_queries.accounts(spark, sf_dir))).withColumn("deal", F.concat_ws("-", "borrower", "year"))
    broken = finance_queries.broken_identities(spark, sf_dir).groupBy("deal").agg(F.count("*").alias("broken"))
    says = F.element_at(F.array(*map(F.lit, ["PROCEED", "DECLINE", "DEFER", "no word"])), (F.col("year") % 4 + 1).cast("int"))
    memos = full.withColumn("text", F.concat(F.lit("We discussed DECLINE before.\nRecommendation\n"), says)).join(broken, "deal", "left").fillna(0, ["broken"])
    return operations.guard(memos)


GUARD_DECISIONS = f"""
WITH m AS ({finance_queries.CREDIT_METRICS}), b AS (SELECT deal, count(*) AS broken FROM ({finance_queries.BROKEN_IDENTITIES}) GROUP BY deal),
g AS (
  SELECT borrower || '-' || year AS deal, ['PROCEED', 'DECLINE', 'DEFER', NULL][year % 4 + 1] AS stated, required, coalesce(broken, 0) AS broken,
    list_position(['DECLINE', 'DEFER', 'PROCEED'], ['PROCEED', 'DECLINE', 'DEFER', NULL][year % 4 + 1]) AS s, list_position(['DECLINE', 'DEFER', 'PROCEED'], required) AS r
  FROM m LEFT JOIN b ON b.deal = borrower || '-' || year
), d AS (
  SELECT *, CASE WHEN broken > 0 THEN 'accounting identity broken' WHEN stated IS NULL THEN 'no recommendation' WHEN s > r THEN 'recommendation contradicts the metrics' END AS reason FROM g
)
SELECT deal, stated, required, CASE WHEN stated IS NOT NULL THEN s < r END AS conservative, reason IS NOT NULL AS blocked, reason FROM d"""


def search_and_grounding(spark, sf_dir):
    """Metrics of the gate (metric, value) that search and the grounding of answers give."""
    recall = search_queries.retrieval_recall(spark, sf_dir)
    ground = finance_queries.grounding_summary(spark, sf_dir)
    rows = recall.selectExpr("stack(3, 'retrieval_recall_at_5', recall_at_5, 'retrieval_recall_at_1', recall_at_1, 'retrieval_mrr', mrr) AS (metric, value)")
    return rows.unionByName(ground.selectExpr("stack(3, 'baseline_grounding_rate', rate, 'baseline_hallucinated_figures', cast(hallucinated AS double), 'baseline_invented_citations', cast(dropped AS double)) AS (metric, value)"))


SEARCH_AND_GROUNDING = f"""
  SELECT 'retrieval_recall_at_5' AS metric, recall_at_5 AS value FROM ({search_queries.RETRIEVAL_RECALL}) UNION ALL SELECT 'retrieval_recall_at_1', recall_at_1 FROM ({search_queries.RETRIEVAL_RECALL})
  UNION ALL SELECT 'retrieval_mrr', mrr FROM ({search_queries.RETRIEVAL_RECALL}) UNION ALL SELECT 'baseline_grounding_rate', rate FROM ({finance_queries.GROUNDING_SUMMARY})
  UNION ALL SELECT 'baseline_hallucinated_figures', hallucinated FROM ({finance_queries.GROUNDING_SUMMARY}) UNION ALL SELECT 'baseline_invented_citations', dropped FROM ({finance_queries.GROUNDING_SUMMARY})"""


def conversation_answers(spark, sf_dir):
    """Every user turn answered from the lines of its conversation's assistant turns, or refused."""
    turns = tables.table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question"), "conv_id", "text")
    said = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("page"), F.col("text").alias("answer_text"))
    contexts = asked.select("question", "conv_id").join(said, "conv_id").select("question", F.col("conv_id").cast("string").alias("document"), "page", F.col("answer_text").alias("text"))
    found = evaluate.extractive_answers(asked, contexts)
    return found.select("question", "refused", "document", "page", "line", F.round("score", 6).alias("score"))


CONVERSATION_ANSWERS = rf"""
WITH q AS (SELECT concat_ws('-', conv_id, turn) AS question, conv_id, text FROM conversations WHERE role = 'user'
), c AS (
  SELECT conv_id, turn, generate_subscripts(ls, 1) AS k, trim(unnest(ls), ' ' || chr(9)) AS line
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM conversations WHERE role = 'assistant')
), l AS (SELECT *, concat_ws('-', conv_id, turn, k) AS id FROM c WHERE length(line) >= 8
), asked AS (SELECT DISTINCT id AS question, token FROM {search_queries.tokens_sql("SELECT question AS id, text FROM q")} WHERE token NOT IN ({search_queries.STOP})
), own AS (SELECT DISTINCT id, token FROM {search_queries.tokens_sql("SELECT id, line AS text FROM l")}
), n AS (SELECT question, count(*) AS n FROM asked GROUP BY question
), m AS (SELECT id, count(*) AS m FROM own GROUP BY id
), hit AS (SELECT question, id, count(*) AS c FROM asked JOIN own USING (token) GROUP BY ALL
), s AS (
  SELECT q.question, CAST(l.conv_id AS VARCHAR) AS document, l.turn AS page, l.line,
    CASE WHEN l.line IS NOT NULL THEN coalesce(c, 0) / greatest(coalesce(n, 1), 1) / (1 + coalesce(m, 0) / 40) END AS score, l.k
  FROM q LEFT JOIN l USING (conv_id) LEFT JOIN n USING (question) LEFT JOIN m USING (id) LEFT JOIN hit ON hit.question = q.question AND hit.id = l.id
  QUALIFY row_number() OVER (PARTITION BY q.question ORDER BY score DESC NULLS LAST, document, page, l.k) = 1
), r AS (SELECT *, coalesce(score < 0.18, TRUE) AS refused FROM s)
SELECT question, refused, CASE WHEN NOT refused THEN document END AS document, CASE WHEN NOT refused THEN page END AS page, CASE WHEN NOT refused THEN line END AS line,
  round(coalesce(score, 0), 6) AS score FROM r"""


def event_windows(spark, sf_dir):
    """Counts of a stream of events by six-hour windows and type."""
    schema = tables.table(spark, sf_dir, "events").schema
    return logs.settled(logs.windowed_counts(logs.read_log(spark, sf_dir, "events.parquet", schema)), "event-windows").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))


EVENT_WINDOWS = """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL"""


def streamed_decisions(spark, sf_dir):
    """The latest event of every user, kept as a stream's state."""
    schema = tables.table(spark, sf_dir, "events").schema
    log = logs.read_log(spark, sf_dir, "events.parquet", schema)
    rows = log.select(F.col("user_id").alias("item_id"), F.col("event_type").alias("decision"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))
    return logs.settled(logs.latest_decisions(rows), "decisions").select("item_id", "decision", "n")


STREAMED_DECISIONS = "SELECT user_id AS item_id, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS n FROM events GROUP BY user_id"

def review_log(spark, sf_dir):
    """Review items after their events came in by a stream that was started twice over the same files: what counts, and what was kept
    apart for what reason."""
    own = tables.table(spark, sf_dir, "events")
    found = own.select(F.col("user_id").alias("item_id"), (F.col("user_id") % 20).alias("deal"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("user_id") % 6 + 1).cast("int")).alias("kind")).filter("item_id % 11 <> 5").distinct()
    queue = found.filter("item_id % 2 = 0")
    items = queue.unionByName(operations.new_items(queue, found))
    decision = F.when(F.col("event_type").isin("click", "signup"), "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "purchase", "escalated").when(F.col("event_id") % 3 == 0, "maybe").otherwise("pending")
    reviewer = F.when(F.col("value") >= 5, F.lit("analyst"))
    path = storage.folder(spark, "review-log")
    for _ in range(2):
        stream = logs.read_log(spark, sf_dir, "events.parquet", own.schema)
        log = logs.appended(stream.select("event_id", F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), decision.alias("decision"), reviewer.alias("reviewer")), path)
    good, bad = operations.judged_events(log, items)
    state = operations.review_state(items, good).select("item_id", "deal", "kind", "decision")
    counts = good.groupBy("item_id").agg(F.count("*").alias("counted"))
    apart = bad.groupBy("item_id").pivot("reason", ["back to pending", "unknown decision", "no reviewer", "unknown item"]).count()
    apart = apart.withColumnsRenamed({"back to pending": "back_to_pending", "unknown decision": "unknown_decision", "no reviewer": "no_reviewer", "unknown item": "unknown_item"})
    return state.join(counts, "item_id", "full").join(apart, "item_id", "full").fillna(0, ["counted", "back_to_pending", "unknown_decision", "no_reviewer", "unknown_item"])


REVIEW_LOG = f"""
WITH e AS (
  SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'purchase' THEN 'escalated' WHEN event_id % 3 = 0 THEN 'maybe' ELSE 'pending' END AS decision,
    user_id % 11 <> 5 AS known FROM events
), r AS (SELECT *, CASE WHEN NOT known THEN 'unknown_item' WHEN decision = 'pending' THEN 'back_to_pending' WHEN decision = 'maybe' THEN 'unknown_decision' WHEN NOT coalesce(value >= 5, FALSE) THEN 'no_reviewer' END AS reason FROM e)
SELECT user_id AS item_id, CASE WHEN bool_and(known) THEN user_id % 20 END AS deal, CASE WHEN bool_and(known) THEN [{", ".join(f"'{k}'" for k in _KINDS)}][user_id % 6 + 1] END AS kind,
  CASE WHEN bool_and(known) THEN coalesce(arg_max(decision, (ts, event_id)) FILTER (reason IS NULL), 'pending') END AS decision, count(*) FILTER (reason IS NULL) AS counted,
  {", ".join(f"count(*) FILTER (reason = '{n}') AS {n}" for n in ("back_to_pending", "unknown_decision", "no_reviewer", "unknown_item"))} FROM r GROUP BY user_id"""

QUERIES = {
    "review_log": (review_log, REVIEW_LOG),
    "call_ledger": (call_ledger, CALL_LEDGER),
    "review_queue": (review_queue, REVIEW_QUEUE),
    "releasable_deals": (releasable_deals, RELEASABLE_DEALS),
    "guard_decisions": (guard_decisions, GUARD_DECISIONS),
    "conversation_answers": (conversation_answers, CONVERSATION_ANSWERS),
    "event_windows": (event_windows, EVENT_WINDOWS),
    "streamed_decisions": (streamed_decisions, STREAMED_DECISIONS),
}
