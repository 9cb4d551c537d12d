"""Queries of the streams with state and their SQL. Status events, messages and notifications are `events`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.contract import register, table
from tessera.sources.files import work_dir
from tessera.streaming import states as S

#: Statuses that senders write, one of them unknown.
WRITTEN = ("EXTRACTING", "TRANSFORMING", "CODIFYING", "REVIEW", "READY", "EXPORTED", "ERROR", "ARCHIVED", "EXTRACTING", "TRANSFORMING", "CODIFYING")
_PICK = "[" + ", ".join(f"'{w}'" for w in WRITTEN) + f"][(event_id * 7 % {len(WRITTEN)} + 1)::INT]"
#: The steps that a case may take, apart from the code's own table.
STEPS = ("NEW>EXTRACTING", "NEW>ERROR", "EXTRACTING>TRANSFORMING", "EXTRACTING>ERROR", "TRANSFORMING>CODIFYING", "TRANSFORMING>ERROR", "CODIFYING>REVIEW", "CODIFYING>READY", "CODIFYING>ERROR", "REVIEW>READY", "REVIEW>ERROR", "READY>EXPORTED", "READY>ERROR", "ERROR>EXTRACTING")
_STEPS = "[" + ", ".join(f"'{s}'" for s in STEPS) + "]"


def _status() -> Column:
    return F.element_at(F.array(*map(F.lit, WRITTEN)), (F.col("event_id") * 7 % len(WRITTEN) + 1).cast("int"))


@register(f"""
WITH e AS (SELECT user_id, event_id, ts, {_PICK} AS status, row_number() OVER w AS i, list({_PICK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, list_reduce(list_prepend('NEW', coalesce(past, [])), lambda s, n: CASE WHEN list_contains({_STEPS}, s || '>' || n) THEN n ELSE s END) AS before FROM e)
SELECT user_id, event_id, before, status, CASE WHEN status = 'ARCHIVED' THEN 'unknown status' WHEN NOT list_contains({_STEPS}, before || '>' || status) THEN 'not allowed' END AS reason,
  CASE WHEN list_contains({_STEPS}, before || '>' || status) AND status = 'EXPORTED' THEN ts WHEN before = 'EXPORTED' THEN max(CASE WHEN list_contains({_STEPS}, before || '>' || status) AND status = 'EXPORTED' THEN ts END) OVER (PARTITION BY user_id ORDER BY i) END AS completed_at FROM s
""")
def case_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status event of a case with the status before it, and why it was rejected; the time of completion after it."""
    source = f"{sf_dir}/events.parquet"
    events = lambda e: e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), _status().alias("status"))
    accepted, rejected = S.transitions(spark, source, spark.read.parquet(source).schema, work_dir(spark), S.CASE, events)
    every = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return every.select(F.col("key").cast("long").alias("user_id"), "event_id", "before", "status", "reason", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


@register("SELECT DISTINCT user_id, event_type, event_type || '_' || user_id AS idempotency_key FROM events")
def idempotent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a user and a kind do their work once, however often they come."""
    source = f"{sf_dir}/events.parquet"
    key = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    work = lambda m: m.select("user_id", "event_type", "idempotency_key")
    return S.once(spark, source, spark.read.parquet(source).schema, work_dir(spark), key, "ts", "3650 days", work)


@register("""
SELECT 'notifications' AS stage, (event_id % 4)::BIGINT AS batch, count(*) AS total, count(*) FILTER (event_type <> 'error') AS queued, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 2
""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, queued and failed notifications of each batch, as the running stream reports them; the notifications come in four files."""
    events, folder = table(spark, sf_dir, "events"), work_dir(spark)
    for i in range(4):  # one file a batch, in their order
        events.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return S.counted(spark, f"{folder}/in", events.schema, folder, "notifications", F.col("event_type") == "error")
