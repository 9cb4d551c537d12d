"""State machines, messages that work once and counts of streams: order, repeats, late rows, restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import states as S

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, key string, status string"


def put(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(i):
    return T0 + timedelta(minutes=i)


def test_transitions_over_batches_and_restarts(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: S.transitions(spark, source, schema, folder, S.CASE, lambda e: e)
    put(spark, source, [(3, at(3), "a", "CODIFYING"), (1, at(1), "a", "EXTRACTING"), (2, at(2), "a", "TRANSFORMING"), (4, at(4), "a", "EXPORTED"), (9, None, "a", "READY"), (10, at(1), None, "READY"), (1, at(1), "b", "ERROR"), (2, at(2), "b", "what")])
    accepted, rejected = run()
    assert sorted((r.key, r.event_id, r.before, r.status) for r in accepted.collect()) == [("a", 1, "NEW", "EXTRACTING"), ("a", 2, "EXTRACTING", "TRANSFORMING"), ("a", 3, "TRANSFORMING", "CODIFYING"), ("b", 1, "NEW", "ERROR")]
    assert sorted((r.key or "", r.event_id, r.reason) for r in rejected.collect()) == [("", 10, "no key, id or time"), ("a", 4, "not allowed"), ("a", 9, "no key, id or time"), ("b", 2, "unknown status")]
    # a new run with the same folder: a late, a repeated and an allowed event, then completion
    put(spark, source, [(0, at(2), "a", "REVIEW"), (4, at(4), "a", "REVIEW"), (5, at(5), "a", "READY"), (6, at(6), "a", "EXPORTED"), (3, at(3), "b", "EXTRACTING")])
    accepted, rejected = run()
    new = {(r.key, r.event_id): r.reason for r in rejected.collect() if r.reason in ("late", "repeated")}
    assert new == {("a", 0): "late", ("a", 4): "repeated"}
    assert {r.key: (r.status, r.completed_at, r.updated_at) for r in S.current(accepted).collect()} == {"a": ("EXPORTED", at(6), at(6)), "b": ("EXTRACTING", None, at(3))}
    again, _ = run()  # nothing new
    assert again.count() == accepted.count()


def test_completion_is_set_and_cleared(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put(spark, source, [(1, at(1), "a", "complete"), (2, at(2), "a", "requires_info"), (1, at(1), "b", "requires_info"), (2, at(2), "b", "complete"), (3, at(3), "b", "done")])
    accepted, rejected = S.transitions(spark, source, spark.createDataFrame([], SCHEMA).schema, folder, S.ANALYSIS, lambda e: e)
    assert {(r.key, r.event_id): r.completed_at for r in accepted.collect()} == {("a", 1): at(1), ("a", 2): None, ("b", 1): None, ("b", 2): at(2)}
    assert [(r.event_id, r.reason, r.completed_at) for r in rejected.collect()] == [(3, "unknown status", at(2))]


def test_tables_of_steps():
    from tessera.plans.states import STEPS

    assert {f"{a}>{b}" for a, own in S.CASE.follow.items() for b in own} == set(STEPS)
    assert S.RUN.step("SUCCESS", "STARTED") == "not allowed" and S.RUN.step("FAILED", "STARTED") is None and S.RUN.step("FAILED", None) == "unknown status"


def test_a_key_works_once(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    columns = "id long, ts timestamp, own string, kind string"
    schema = spark.createDataFrame([], columns).schema
    key = S.idempotency_key(F.col("kind"), F.col("own"), F.col("ts"))
    run = lambda: S.once(spark, source, schema, folder, key, "ts", "10 minutes", lambda m: m.select("idempotency_key", "kind"), files=1)
    put(spark, source, [(1, at(0), "k1", "x"), (2, at(1), "k1", "x"), (3, at(2), None, "x"), (4, at(2), None, "x"), (5, at(3), None, "y")], columns)
    first = sorted(r.idempotency_key for r in run().collect())
    assert first == ["k1", "x_2024-01-01T00:02:00.000000", "y_2024-01-01T00:03:00.000000"]
    put(spark, source, [(6, at(5), "k1", "x"), (7, at(5), "k2", "x")], columns)  # the same key in a later run
    assert sorted(r.idempotency_key for r in run().collect()) == sorted([*first, "k2"])
    put(spark, source, [(8, at(60), "k3", "x")], columns)
    run()
    put(spark, source, [(9, at(1), "k4", "x")], columns)  # older than the latest time by more than the delay
    assert sorted(r.idempotency_key for r in run().collect()) == sorted([*first, "k2", "k3"])


def test_counts_of_batches(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    columns = "id long, failed_at string"
    schema = spark.createDataFrame([], columns).schema
    failed = F.col("failed_at") != ""
    for rows in ([(1, ""), (2, "x"), (3, None)], [(4, "x")]):
        put(spark, source, rows, columns)
    run = lambda: {(r.batch, r.total, r.queued, r.errors) for r in S.counted(spark, source, schema, folder, "mails", failed).collect()}
    assert {x[1:] for x in run()} == {(3, 2, 1), (1, 0, 1)}
    put(spark, source, [(5, "")], columns)
    got = run()
    assert {x[1:] for x in got} == {(3, 2, 1), (1, 0, 1), (1, 1, 0)} and {x[0] for x in got} == {0, 1, 2}


def test_query_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    put(spark, f"file://{tmp_path}/in", [])
    accepted, rejected = S.transitions(spark, f"file://{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, f"file://{tmp_path}/out", S.RUN, lambda e: e)
    assert accepted.count() == rejected.count() == 0 and S.current(accepted).count() == 0
