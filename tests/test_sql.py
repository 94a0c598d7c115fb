"""SQL functions against the expressions they stand for, and vocabularies of the caller's."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import geo
from emberline.functions import text as tx
from emberline.operators import vocabulary
from emberline.sources import sql


def test_row_functions_equal_the_expressions(spark):
    sql.register_row_functions(spark)
    names = ["IAP_arch_e_port_20260818_2100_Elk_Creek_COGMF000114_0819day.pdf", "ops_11x17_20260818_2100_Elk.pdf", "x.pdf", None, "", "ops_8.5x11_land_20260818_2100__0819.pdf", "_20260818_2100_", "a_PORT_20260818_0001_X_1199NIGHT.zip", "arch_e_20260818_2100_COGMF000114.pdf", "port_20260818_2100_a.pdf"]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    want = d.select("name", F.inline(F.array(tx.parse_product_filename(F.col("name")))))
    assert spark.sql("SELECT name, p.* FROM {d}, LATERAL parse_product_filename(name) p", d=d).collect() == want.collect()
    assert spark.sql("SELECT unit_tokens(name, 2026) AS t FROM {d}", d=d).collect() == d.select(tx.unit_tokens(F.col("name"), 2026).alias("t")).collect()
    labels = spark.createDataFrame([(x,) for x in ["112° 30' W", "45°", "-45° 15' 30\"", "112°", "190°", "45° 61'", "x", None, " 45°N ", "10° 5′ S", "7º2.5'1″E"]], "t string")
    assert spark.sql("SELECT parse_coord(t) AS c FROM {d}", d=labels).collect() == labels.select(tx.parse_coord(F.col("t")).alias("c")).collect()
    p = spark.createDataFrame([(-114.1, 45.1), (0.0, 89.9), (None, 1.0)], "lon double, lat double")
    r = geo.rect(F.col("lon"), F.col("lat"))
    want = p.select(geo.pad(geo.snap(r), 0.1, 85).alias("b"), geo.in_box(F.col("lon"), F.col("lat"), r).alias("i"), geo.box_contains(r, geo.snap(r)).alias("c")).collect()
    assert spark.sql("SELECT box_pad(box_snap(r, 0.25D), 0.1D, 85D) AS b, in_box(lon, lat, r) AS i, box_contains(r, box_snap(r, 0.25D)) AS c FROM (SELECT *, rect(lon, lat, 0.6D, 0.5D) AS r FROM {p})", p=p).collect() == want


def test_table_functions_need_no_join(spark):
    """A table function of a row reads no table: the plan has neither a product nor an exchange."""
    sql.register_row_functions(spark)
    plan = spark.sql("SELECT id, p.product, d.local_day FROM (SELECT id, concat('ops_20260818_2100_', id) AS name, TIMESTAMP_NTZ '2024-03-09 12:00:00' AS t FROM range(9)), LATERAL parse_product_filename(name) p, LATERAL local_days('America/Denver', t, t) d")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "Exchange" not in text
    assert plan.count() == 9


def test_labels_follow_the_callers_table(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["ops", "OPS_arch", "ops_arch_x", "opsy", None, "", "iap", "ops"])], "k int, product string")
    table = lambda *v: spark.createDataFrame(v, "base string, label string, rank int")
    told = lambda t: {r.k: (r.base, r.label, r["rank"]) for r in vocabulary.label_products(rows, t).collect()}
    got = told(table(("ops", "Operations", 1), ("ops_arch", "Large", 2), ("ops", "Later", 9)))
    assert got == {0: ("ops", "Operations", 1), 1: ("ops_arch", "Large", 2), 2: ("ops_arch", "Large (x)", 2), 3: ("other", "Other", None), 4: ("other", "Other", None), 5: ("other", "Other", None), 6: ("other", "Other", None), 7: ("ops", "Operations", 1)}
    assert told(table(("ops", "Einsatz", 1)))[1] == ("ops", "Einsatz (arch)", 1) and told(table())[0] == ("other", "Other", None)
