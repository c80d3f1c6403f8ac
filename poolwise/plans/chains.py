"""Registered queries over given decision logs, laid out from every event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import ROLLING_ACTIONS
from ..operators import decision_log
from ..session import ship_package
from ..sources.tables import table
from .registry import query

BASELINE = "rolling-fifo-open"
BUDGET = 3
HOLD_SECONDS = 7200.0

# The log's layout, the same in Spark and in the oracle.
CHOICES = (
    "rolling-fifo-open,native-fifo,rolling-preemptive-open-d0000",
    "rolling-fifo-open,rolling-preemptive-open-d0000,rolling-preemptive-open-loss-aware",
    "rolling-preemptive-open-d0000,rolling-fifo-open,native-fifo",
)
SHORT_CHOICE, FOREIGN_CHOICE = "rolling-fifo-open,native-fifo", "rolling-fifo-open,native-fifo,elsewhere"
SELECTED = (BASELINE, "rolling-preemptive-open-d0000", "native-fifo")


def _pick(number: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def logged_decisions(spark, sf_dir):
    """Every event as a decision of its user's day, not yet fingerprinted."""
    ship_package(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    key = F.col("event_id")
    day = F.to_date("ts").cast("string")
    rows = events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), day).alias("chain_id"),
        F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1000000D")).alias("cutoff_seconds"),
        F.sha2(F.concat(F.lit("o"), key.cast("string")), 256).alias("observation_fingerprint"),
        F.when(key % 61 == 4, SHORT_CHOICE).when(key % 67 == 5, FOREIGN_CHOICE).otherwise(_pick(key, CHOICES)).alias("candidate_action_ids"),
        _pick(key, SELECTED).alias("selected_action_id"),
        F.when(key % 7 == 0, F.array(F.lit("native-fifo"))).otherwise(F.array(*[F.lit(a) for a in SELECTED])).alias("eligible_action_ids"),
    )
    packed = rows.groupBy("chain_id").agg(
        F.array_sort(F.collect_list(F.struct("cutoff_seconds", *[c for c in rows.columns if c not in ("chain_id", "cutoff_seconds")]))).alias("_rows")
    )
    return packed.select("chain_id", F.posexplode("_rows").alias("decision_index", "_row")).select(
        "chain_id", F.col("decision_index").cast("long").alias("decision_index"), "_row.*"
    )


LOG = f"""
dl AS (SELECT event_id, user_id, 'u' || user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS chain_id,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE) AS BIGINT) AS cutoff_seconds, sha256('o' || event_id) AS observation_fingerprint,
    CASE WHEN event_id % 61 = 4 THEN '{SHORT_CHOICE}' WHEN event_id % 67 = 5 THEN '{FOREIGN_CHOICE}' ELSE {list(CHOICES)}[event_id % 3 + 1] END AS candidate_action_ids,
    {list(SELECTED)}[event_id % 3 + 1] AS selected_action_id, CASE WHEN event_id % 7 = 0 THEN ['native-fifo'] ELSE {list(SELECTED)} END AS eligible FROM events),
di AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY cutoff_seconds, event_id) - 1 AS decision_index FROM dl)
"""


def recorded_chain(spark, sf_dir):
    """The log with its fingerprints, then rows altered, relinked and lost after they were recorded."""
    log = logged_decisions(spark, sf_dir).withColumn("_text", decision_log.canonical_row(decision_log.FIELDS))
    carried = ["event_id", *decision_log.FIELDS, "_text"]
    packed = log.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("decision_index", *[c for c in carried if c != "decision_index"]))).alias("_rows"))
    nobody = F.lit(None).cast("string")

    def record(state: Column, row: Column) -> Column:
        own = F.sha2(F.concat(F.coalesce(state["last"], F.lit("-")), F.lit("|"), row["_text"]), 256)
        link = F.struct(state["last"].alias("previous_fingerprint"), own.alias("decision_fingerprint"))
        return F.struct(own.alias("last"), F.array_append(state["links"], link).alias("links"))

    begin = F.struct(nobody.alias("last"), F.array().cast("array<struct<previous_fingerprint:string,decision_fingerprint:string>>").alias("links"))
    # A chain is one user's day, so its array is short.
    linked = packed.select("chain_id", F.explode(F.arrays_zip("_rows", F.aggregate("_rows", begin, record, lambda s: s["links"]).alias("_links"))).alias("x"))
    rows = linked.select("chain_id", "x._rows.*", "x._links.*").drop("_text")
    key = F.col("event_id")
    return rows.where(key % 911 != 3).withColumns(
        {
            "selected_action_id": F.when(key % 401 == 7, "altered").otherwise(F.col("selected_action_id")),
            "previous_fingerprint": F.when(key % 613 == 5, F.sha2(F.lit("forged"), 256)).otherwise(F.col("previous_fingerprint")),
        }
    )


def _text_sql(fields=decision_log.FIELDS) -> str:
    return " || ".join(f"'{f}=' || length(CAST({f} AS VARCHAR)) || ':' || {f} || ';'" for f in fields)


@query(
    "q_decision_chain",
    f"""WITH RECURSIVE {LOG},
tx AS (SELECT *, {_text_sql()} AS txt FROM di),
fp AS (SELECT chain_id, decision_index, CAST(NULL AS VARCHAR) AS prev, sha256('-|' || txt) AS own FROM tx WHERE decision_index = 0
  UNION ALL SELECT tx.chain_id, tx.decision_index, fp.own, sha256(fp.own || '|' || txt) FROM fp JOIN tx ON tx.chain_id = fp.chain_id AND tx.decision_index = fp.decision_index + 1),
gl AS (SELECT di.* REPLACE (CASE WHEN event_id % 401 = 7 THEN 'altered' ELSE selected_action_id END AS selected_action_id),
    CASE WHEN event_id % 613 = 5 THEN sha256('forged') ELSE fp.prev END AS previous_fingerprint, fp.own AS decision_fingerprint
  FROM di JOIN fp ON fp.chain_id = di.chain_id AND fp.decision_index = di.decision_index WHERE event_id % 911 <> 3),
ck AS (SELECT *, lag(decision_fingerprint) OVER w AS before, lag(decision_index) OVER w AS bi, sha256(coalesce(previous_fingerprint, '-') || '|' || {_text_sql()}) AS again
  FROM gl WINDOW w AS (PARTITION BY chain_id ORDER BY decision_index)),
rs AS (SELECT chain_id, decision_index, CASE WHEN decision_index <> coalesce(bi + 1, 0) THEN 'index' WHEN previous_fingerprint IS DISTINCT FROM before THEN 'previous'
    WHEN again <> decision_fingerprint THEN 'fingerprint' END AS why FROM ck)
SELECT chain_id, count(*) AS decision_count, count(why) = 0 AS chain_valid, min(decision_index) FILTER (why IS NOT NULL) AS first_broken_index,
  first(why ORDER BY decision_index) FILTER (why IS NOT NULL) AS broken_by FROM rs GROUP BY 1""",
)
def decision_chain(spark, sf_dir):
    return decision_log.verify_chain(recorded_chain(spark, sf_dir))


@query(
    "q_plan_replay",
    f"""WITH {LOG},
pl AS (SELECT chain_id, observation_fingerprint, candidate_action_ids, event_id FROM di WHERE event_id % 17 <> 2 UNION ALL
  SELECT chain_id, observation_fingerprint, candidate_action_ids, event_id FROM di WHERE event_id % 501 = 11),
en AS (SELECT chain_id, observation_fingerprint, count(*) AS n, min(candidate_action_ids) AS c FROM pl GROUP BY 1, 2),
bad AS (SELECT chain_id, max(n) > 1 AS refused FROM en GROUP BY 1),
jd AS (SELECT di.chain_id, di.decision_index, di.observation_fingerprint, c, CASE WHEN refused THEN 'plan-names-an-observation-twice' WHEN n IS NULL THEN 'unseen-observation'
    WHEN len(string_split(c, ',')) <> {BUDGET} OR len(list_distinct(string_split(c, ','))) <> {BUDGET} OR NOT list_has_all({list(ROLLING_ACTIONS)}, string_split(c, ','))
      OR NOT list_contains(string_split(c, ','), '{BASELINE}') THEN 'choice-outside-budget-or-catalog' END AS why
  FROM di LEFT JOIN en USING (chain_id, observation_fingerprint) LEFT JOIN bad ON bad.chain_id = di.chain_id),
st AS (SELECT chain_id, min(decision_index) AS stop FROM jd WHERE why IS NOT NULL GROUP BY 1)
SELECT jd.chain_id, decision_index, observation_fingerprint, coalesce(decision_index = stop, false) AS stopped,
  CASE WHEN coalesce(decision_index = stop, false) THEN NULL ELSE c END AS candidate_action_ids, CASE WHEN decision_index = stop THEN why END AS stop_reason
FROM jd LEFT JOIN st ON st.chain_id = jd.chain_id WHERE stop IS NULL OR decision_index <= stop""",
)
def plan_replay(spark, sf_dir):
    """The recorded plan lacks every seventeenth observation and names some twice."""
    log = logged_decisions(spark, sf_dir)
    entries = log.select("chain_id", "observation_fingerprint", "candidate_action_ids", "event_id")
    plan = entries.where(F.col("event_id") % 17 != 2).unionByName(entries.where(F.col("event_id") % 501 == 11))
    return decision_log.replay_plan(log, plan.drop("event_id"), ROLLING_ACTIONS, BUDGET, BASELINE)


@query(
    "q_minimum_hold",
    f"""WITH RECURSIVE {LOG},
us AS MATERIALIZED (SELECT 'u' || user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY cutoff_seconds, event_id) - 1 AS i, cutoff_seconds::DOUBLE AS t, selected_action_id AS s, eligible FROM dl),
f AS (SELECT chain_id, CAST(-1 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS DOUBLE) AS since, false AS held FROM us WHERE i = 0
  UNION ALL SELECT u.chain_id, u.i, u.t, CASE WHEN k THEN f.a ELSE s END, CASE WHEN k THEN f.since WHEN s = '{BASELINE}' THEN NULL WHEN s = f.a THEN f.since ELSE u.t END, k
  FROM f JOIN (SELECT * FROM us) u ON u.chain_id = f.chain_id AND u.i = f.i + 1,
    LATERAL (SELECT coalesce(u.s = '{BASELINE}' AND f.a <> '{BASELINE}' AND u.t - f.since < {HOLD_SECONDS} - 1e-9 AND list_contains(u.eligible, f.a), false) AS k))
SELECT chain_id, i AS decision_index, t AS cutoff_seconds, a AS action_id, since AS active_since, held FROM f WHERE i >= 0""",
)
def minimum_hold(spark, sf_dir):
    """The decisions of each user over the whole trace, with a hold of two hours."""
    rows = logged_decisions(spark, sf_dir)
    packed = rows.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("cutoff_seconds", "event_id", "selected_action_id", "eligible_action_ids"))).alias("_rows")
    )
    log = packed.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chain_id"), F.posexplode("_rows").alias("decision_index", "_row"))
    return decision_log.hold_actions(log.select("chain_id", "decision_index", "_row.*"), HOLD_SECONDS, BASELINE)
