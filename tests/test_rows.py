"""Row numbers, rules with policies, tables updated by key, deep pages and thresholds on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages as G
from tessera.operators import rules as U
from tessera.operators.ordinals import file_ordinals, numbered
from tessera.sources import versions as V


@pytest.mark.parametrize("parts", [1, 64])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    df = spark.range(700).withColumn("k", F.xxhash64("id")).repartition(7)
    got = numbered(df, [F.desc("k")], parts=parts).orderBy(F.desc("k")).collect()
    assert [r.ordinal for r in got] == list(range(700))
    assert numbered(df.limit(0), [F.asc("k")], parts=parts).count() == 0


def test_numbers_in_files_do_not_depend_on_splits(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text("a\n" + "".join(f"{i}-{j}\n" for j in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for per_file in (True, False):
                for r in file_ordinals(spark.read.csv(f"file://{tmp_path}", header=True), per_file=per_file).collect():
                    i, j = map(int, r.a.split("-"))
                    assert r.row_index == j + (0 if per_file else 2000 * i)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


PROFILE = {
    "transformations": {"make": [{"rule": "normalize_case", "params": {"case": "title"}}, {"rule": "map_values", "params": {"mappings": {"Ford": "FORD"}}}], "year": [{"rule": "convert_to_int"}, {"rule": "validate_range", "params": {"min": 1980, "max": 2030}}], "model": [{"rule": "remove_extra_spaces"}]},
    "validations": {"required_fields": ["make"], "data_quality": [{"rule": "no_empty_strings", "fields": ["model"]}]},
}


def test_rules_and_policies(spark, tmp_path):
    rows = [(1, "ford", " a   b ", "2019.0"), (2, "KIA", "", "abc"), (3, None, "x", "1950"), (4, " ", None, None)]
    df = spark.createDataFrame(rows, "id int, make string, model string, year string")
    judged = {r.id: r for r in U.apply_rules(df, PROFILE).collect()}
    assert (judged[1].make, judged[1].model, judged[1].year, judged[1].outcome, judged[1].errors) == ("FORD", "a b", "2019", "kept", [])
    assert [(e.field, e.rule, e.value) for e in judged[2].errors] == [("year", "convert_to_int", "abc"), ("model", "no_empty_strings", "")] and judged[2].outcome == "kept"
    assert [(e.field, e.rule) for e in judged[3].errors] == [("year", "validate_range"), ("make", "required")] and judged[3].outcome == "failed"
    with pytest.raises(ValueError, match="2 rows failed"):
        U.split(U.apply_rules(df, PROFILE), f"file://{tmp_path}/a")
    skip = PROFILE | {"error_handling": {"required_field_missing": "skip", "on_transformation_error": "fail"}}
    assert {r.id: r.outcome for r in U.apply_rules(df, skip).collect()} == {1: "kept", 2: "failed", 3: "failed", 4: "skipped"}
    kept, aside = U.split(U.apply_rules(df, PROFILE | {"error_handling": {"required_field_missing": "skip"}}), f"file://{tmp_path}/b")
    assert {r.id for r in kept.collect()} == {1, 2} and {r.id for r in aside.collect()} == {3, 4}
    for bad in ({"transformations": {"a": [{"rule": "what"}]}}, {"error_handling": {"on_validation_error": "what"}}):
        with pytest.raises(ValueError):
            U.apply_rules(df, bad)
    assert {r.outcome for r in U.apply_rules(df, {}).collect()} == {"kept"}


def test_corrupt_lines_are_set_aside_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("make,model,year\nFord,a,2019\nKia,b\nKia,c,x\nKia,d,2001,more\n")
    schema = spark.createDataFrame([], "make string, model string, year int").schema
    rows = U.read_rows(spark, f"file://{tmp_path}/in", schema, header="true")
    kept, aside = U.split(U.apply_rules(rows, PROFILE), f"file://{tmp_path}/out")
    assert [(r.make, r.year) for r in kept.collect()] == [("FORD", "2019")]
    assert {(r[U.CORRUPT], r.outcome, r.errors[0].rule) for r in aside.collect()} == {(x, "corrupt", "corrupt") for x in ("Kia,b", "Kia,c,x", "Kia,d,2001,more")}


def test_updates_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(i, f"v{i}", i) for i in range(100)], "id long, a string, b int")
    V.create(df, path, ["id"], 8)
    with pytest.raises(RuntimeError):
        V.create(df, path, ["id"], 8)
    changes = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (500, "z", 1), (None, "n", 1)], "id long, a string, at int")
    assert V.update(spark, path, changes.select("id", "a"), ["id"], latest=F.lit(1)) == 2
    folders = V._manifest(spark, path, 2)
    assert sum(f != V._manifest(spark, path, 1)[b] for b, f in folders.items()) <= 2  # the buckets of two keys alone
    now = {r.id: (r.a, r.b) for r in V.read(spark, path).collect()}
    assert len(now) == 100 and now[3][0] in ("x", "y") and now[3][1] == 3 and now[4] == ("v4", 4)
    assert {r.id: r.a for r in V.read(spark, path, 1).collect()}[3] == "v3"
    assert V.update(spark, path, spark.createDataFrame([(500, "z"), (4, None)], "id long, a string"), ["id"], insert=True) == 3
    now = {r.id: (r.a, r.b) for r in V.read(spark, path).collect()}
    assert len(now) == 101 and now[500] == ("z", None) and now[4] == (None, 4)
    assert V.update(spark, path, changes.limit(0).select("id", "a"), ["id"]) == 3  # nothing to do


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    V.create(spark.createDataFrame([(1, "a")], "id long, a string"), path, ["id"], 2)
    broken = spark.createDataFrame([(1, "b")], "id long, a string").withColumn("a", F.when(F.col("a") == "b", F.raise_error("lost")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="lost"):
        V.update(spark, path, broken, ["id"])
    assert [tuple(r) for r in V.read(spark, path).collect()] == [(1, "a")] and V.version(spark, path) == 1
    at = V._manifest(spark, path, 1)
    V.update(spark, path, spark.createDataFrame([(1, "c")], "id long, a string"), ["id"])
    with pytest.raises(RuntimeError):  # another writer that started from version 1
        V._commit(spark, path, 2, at)
    assert [tuple(r) for r in V.read(spark, path).collect()] == [(1, "c")]


def test_overlay_takes_the_latest(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, code string")
    fix = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1), (2, None, 5)], "k int, to string, at int")
    assert {tuple(r) for r in V.overlay(rows, fix, ["k"], "code", "to", F.col("at")).collect()} == {(1, "y"), (2, "b"), (3, "z")}


def test_pages_equal_a_whole_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 5.0, 5.0, 5.0, rng.random() * 100]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, id long")
    for down in (False, True):
        want = sorted(rows, key=lambda r: (r[0] is None, (-r[0] if down else r[0]) if r[0] is not None else 0, r[1]))
        for offset, limit in ((0, 7), (1490, 20), (2990, 30), (2999, 1), (3000, 5), (700, 300)):
            got = G.page(df, "v", [F.asc("id")], offset, limit, descending=down, enough=50).collect()
            assert [(r.v, r.id) for r in got] == want[offset : offset + limit]
    assert G.page(df.limit(0), "v", [F.asc("id")], 0, 5).count() == 0


def test_a_page_sorts_its_range_alone(spark):
    df = spark.range(100_000).withColumn("v", F.col("id") % 1000 * 1.0)
    rows = G.page(df, "v", [F.asc("id")], 50_000, 10, enough=5000)
    kept = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in kept and [r.id for r in rows.collect()] == [500 + 1000 * i for i in range(10)]


def test_thresholds(spark):
    rows = [(0.95, True)] * 50 + [(0.9, True)] * 48 + [(0.9, False)] * 1 + [(0.5, False)] * 10 + [(None, True)]
    got = {round(r.threshold, 2): r for r in G.threshold_sweep(spark.createDataFrame(rows, "s double, hit boolean"), "s", "hit").collect()}
    assert (got[0.95].accepted, got[0.95].precision) == (50, 1.0) and (got[0.9].accepted, got[0.9].precision) == (99, round(98 / 99, 6))
    assert [t for t, r in got.items() if r.recommended] == [0.51] and got[0.0].n == 109 and got[1.0].accepted == 0
