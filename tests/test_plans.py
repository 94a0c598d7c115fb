"""Registered queries against DuckDB on the smallest tables, and plans that must not hold products."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.operators import forecast
from emberline.plans import ORACLES, PLANS, adapters, landed_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages embeddings".split()


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    rows = PLANS[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in rows.collect()), key=key)
    assert got == sorted((tuple(map(_norm, r)) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", ["detections_in_boxes", "perimeter_asof", "nearest_hours", "wind_samples", "matched_slugs", "matched_sitrep", "asset_classes", "frame_times", "forecast_links", "ramp_colors", "matched_incidents", "name_ratios", "resumed_pages", "clashing_slugs"])
def test_no_products(spark, name):
    plan = PLANS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_manifest_pages_are_made_in_parts_that_follow_the_rows(spark, monkeypatch):
    """however many rows, a task sorts and groups about PART_ROWS of them, with the same result."""
    landed, land = [], landed_queries.land_documents
    monkeypatch.setattr(adapters, "PART_ROWS", 1000)
    monkeypatch.setattr(landed_queries, "land_documents", lambda documents, *more: landed.append(documents) or land(documents, *more))
    test_query_equals_sql(spark, "landed_manifest")
    plan = landed[0]._jdf.queryExecution().optimizedPlan().toString()
    parts = [line.split(",")[-1].split(")")[0].strip() for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(parts) == 3 and set(parts) == {"6"}, plan


def _in_parts(spark, monkeypatch, name):
    """The query's rows are right where its tables are in six parts, and its files meet their runs once."""
    monkeypatch.setattr(adapters, "PART_ROWS", 1000)
    test_query_equals_sql(spark, name)
    plan = PLANS[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    parts = [line.split(",")[-1].split(")")[0].strip() for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert plan.count("Join Inner") == 1 and "LeftOuter" not in plan and parts == ["6", "6"], plan


def test_ticks_take_one_pass_in_parts(spark, monkeypatch):
    """F15"""
    _in_parts(spark, monkeypatch, "run_ticks")


def test_ticks_reach_over_whole_horizons(spark):
    """every run has its ticks, over all hours of its horizon; a window is the caller's, and runs of no or a negative horizon don't count backwards."""
    files = adapters.view(spark, SF, "run_availability").groupBy("run_key").agg((forecast.told_horizon(F.max(F.when(F.col("ok"), F.col("n")))) * 7 + 1).alias("n"))
    got = PLANS["run_ticks"](spark, SF).groupBy("run_key").agg(F.count(F.lit(1)).alias("got"))
    assert files.count() > 1400 and files.join(got, "run_key", "full").filter("not n <=> got").count() == 0
    at = lambda h: f"TIMESTAMP_NTZ '2024-03-0{1 + h // 24} {h % 24:02}:00:00'"
    runs = spark.sql(f"SELECT * FROM VALUES (1, {at(22)}, 5), (2, {at(0)}, 0), (3, {at(0)}, -2), (4, {at(0)}, NULL) AS r(run_key, run_time, horizon_hours)")
    told = lambda t: sorted((r.run_key, r.t.day, r.t.hour) for r in t.collect())
    ticks = [(1, 1, 22), (1, 1, 23), (1, 2, 0), (1, 2, 1), (1, 2, 2), (1, 2, 3), (2, 1, 0)]
    assert told(forecast.run_ticks(runs)) == ticks
    assert told(forecast.run_ticks(runs, F.expr(at(23)), F.expr(at(26)))) == ticks[1:5]
    assert told(forecast.run_ticks(runs, None, F.expr(at(22)))) == [ticks[0], ticks[6]]


def test_choices_take_one_pass_in_parts(spark, monkeypatch):
    """F16"""
    _in_parts(spark, monkeypatch, "nearest_choices")


def test_rows_of_a_source_are_not_shuffled(spark):
    """rows of fires and detections are the query's last step, nothing above them shuffles or joins."""
    plan = PLANS["detections_source"](spark, SF)._jdf.queryExecution().optimizedPlan()
    for i in range(plan.children().size()):
        node = plan.children().apply(i)
        while node.nodeName() == "Project":
            node = node.children().apply(0)
        assert plan.nodeName() == "Union" and node.nodeName() == "Generate" and "inline(__fires" in node.toString().splitlines()[0], node.toString()


def test_nearest_stops_of_runs(spark):
    """with and without a wanted reach, ties to the smaller; runs without a horizon reach to the last band."""
    runs = spark.createDataFrame([(1, 100, 60), (2, 0, 30), (3, None, 84), (4, 24, None)], "run_key int, horizon_hours int, reach int")
    assert {r.run_key: r.stop for r in forecast.nearest_stop(runs).collect()} == {1: 100, 2: 240, 3: 240, 4: 24}
    assert {r.run_key: r.stop for r in forecast.nearest_stop(runs, F.col("reach")).collect()} == {1: 48, 2: 24, 3: 72, 4: 24}
