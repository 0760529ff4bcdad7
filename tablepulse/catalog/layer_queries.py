"""Bronze, Silver and Gold on orders; the finished orders are in Silver already."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import ORDERS_END
from tablepulse.functions.times import moment
from tablepulse.operators import medallion
from tablepulse.operators.relational import accepted_rows, rows_not_in
from tablepulse.sources import facts
from tablepulse.sources.tables import scan

def _text_sql(*names: str) -> str:
    return " || ".join(f"coalesce(len(CAST({n} AS VARCHAR)) || ':' || CAST({n} AS VARCHAR), '-')" for n in names)


PLACED = _text_sql("_pipeline_run_id", "_loaded_at", "_row_number")
CONTENT = _text_sql("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
KEY = f"CASE WHEN _loaded_at IS NOT NULL AND _row_number IS NOT NULL THEN sha256({PLACED}) ELSE sha256({PLACED} || {CONTENT}) END"
SILVER = f"""
    sv AS (SELECT {KEY} AS _row_key, _pipeline_run_id, _loaded_at AS _bronze_loaded_at, _loaded_at IS NULL AS _is_quarantined,
           o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM v_bronze)"""


def _silver(t):
    return medallion.to_silver(t["v_bronze"])


def _known(t):
    """Silver as it stands: the finished orders."""
    return _silver(t).filter(F.col("o_orderstatus") == "F")


@query("src_06_whole_table", "SELECT COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS price FROM lineitem")
def _(t):
    return scan(t.spark, f"{t.folder}/lineitem.parquet").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query("snk_01_bronze_rows", """
    SELECT 'orders.csv' AS _source_file, 'run_1' AS _pipeline_run_id, 2 AS _schema_version, event_id,
           CASE WHEN value > 95 THEN NULL ELSE value END AS value FROM events""")
def _(t):
    rows = t["events"].select("event_id", F.when(F.col("value") > 95, float("nan")).otherwise(F.col("value")).alias("value"))
    bronze = facts.bronze_rows(rows, "orders.csv", "run_1", 2, moment(ORDERS_END))
    return bronze.drop("_ingestion_id", "_ingestion_ts")


@query("med_01_silver_additions", f"""
    WITH {SILVER} SELECT * FROM sv WHERE o_orderstatus <> 'F'""")
def _(t):
    added = medallion.silver_additions(t["v_bronze"], _known(t))
    return added.drop("_source_file", "_schema_version", "_quality_score")


@query("med_01_additions_of_one_run", f"""
    WITH {SILVER} SELECT * FROM sv WHERE o_orderstatus <> 'F' AND _pipeline_run_id = '5-LOW'""")
def _(t):
    added = medallion.silver_additions(t["v_bronze"], _known(t), "5-LOW")
    return added.drop("_source_file", "_schema_version", "_quality_score")


@query("med_02_run_once", f"""
    WITH {SILVER} SELECT _row_key, _pipeline_run_id FROM sv WHERE _pipeline_run_id NOT IN ('1-URGENT', '2-HIGH')""")
def _(t):
    known = _known(t).filter(F.col("_pipeline_run_id").isin("1-URGENT", "2-HIGH"))
    return medallion.silver_additions(t["v_bronze"], known, mode="run_once").select("_row_key", "_pipeline_run_id")


@query("med_03_gold", f"""
    WITH {SILVER} SELECT _pipeline_run_id, COALESCE(o_orderstatus, 'unknown') AS _aggregation_key, COUNT(*) AS _row_count, 1.0e0 AS _quality_score_avg
    FROM sv WHERE NOT _is_quarantined GROUP BY ALL""")
def _(t):
    return medallion.to_gold(_silver(t), "o_orderstatus", numeric=False)


@query("med_04_gold_measures", f"""
    WITH {SILVER} SELECT _pipeline_run_id, CAST(o_custkey AS VARCHAR) AS _aggregation_key, COUNT(*) AS _row_count, 1.0e0 AS _quality_score_avg,
           CAST(SUM(o_orderkey) AS BIGINT) AS o_orderkey_sum, ROUND(AVG(o_orderkey), 4) AS o_orderkey_avg,
           CAST(SUM(o_custkey) AS BIGINT) AS o_custkey_sum, ROUND(AVG(o_custkey), 4) AS o_custkey_avg,
           ROUND(SUM(o_totalprice), 2) AS o_totalprice_sum, ROUND(AVG(o_totalprice), 6) AS o_totalprice_avg
    FROM sv WHERE NOT _is_quarantined GROUP BY ALL""")
def _(t):
    gold = medallion.to_gold(_silver(t), "o_custkey")
    gold = gold.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey_sum", "o_custkey_sum")})
    digits = {"o_orderkey_avg": 4, "o_custkey_avg": 4, "o_totalprice_sum": 2, "o_totalprice_avg": 6}
    return gold.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("med_05_all_null_rows", """
    SELECT event_id, user_id IS NULL AND value IS NULL AS all_null FROM v_events_dirty""")
def _(t):
    return t["v_events_dirty"].select("event_id", medallion.all_null(["user_id", "value"]).alias("all_null"))


@query("med_06_run_counts", f"""
    WITH {SILVER} SELECT _pipeline_run_id, COUNT(*) AS rows_merged, COUNT(*) FILTER (_is_quarantined) AS rows_quarantined FROM sv GROUP BY 1""")
def _(t):
    return medallion.run_counts(_silver(t))


@query("med_06_gold_counts", f"""
    WITH {SILVER} SELECT _pipeline_run_id, COUNT(DISTINCT o_orderstatus) AS gold_rows FROM sv WHERE NOT _is_quarantined GROUP BY 1""")
def _(t):
    return medallion.gold_counts(medallion.to_gold(_silver(t), "o_orderstatus"))


@query("flt_05_accepted_rows", f"WITH {SILVER} SELECT o_orderkey FROM sv WHERE NOT _is_quarantined AND _pipeline_run_id = '2-HIGH'")
def _(t):
    return accepted_rows(_silver(t), "2-HIGH").select("o_orderkey")


@query("jn_03_rows_not_in_target", """
    SELECT _pipeline_run_id, _loaded_at, _row_number FROM v_bronze b WHERE NOT EXISTS (SELECT 1 FROM v_silver_known s
        WHERE s._pipeline_run_id = b._pipeline_run_id AND s._loaded_at IS NOT DISTINCT FROM b._loaded_at AND s._row_number = b._row_number)""")
def _(t):
    keys = ["_pipeline_run_id", "_loaded_at", "_row_number"]
    return rows_not_in(t["v_bronze"], t["v_silver_known"], keys).select(*keys)


@query("jn_04_orders_without_lines", """
    SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)""")
def _(t):
    lines = t["lineitem"].select(F.col("l_orderkey").alias("o_orderkey"))
    return rows_not_in(t["orders"], lines, ["o_orderkey"]).select("o_orderkey")


@query("lin_01_lineage_rows", f"""
    WITH {SILVER} SELECT 'orders' AS dataset_id, _pipeline_run_id AS pipeline_run_id, TIMESTAMP '{ORDERS_END}' AS event_at, 'BRONZE' AS source_layer,
           'SILVER' AS target_layer, 'orders_raw' AS source_table, 'orders_silver' AS target_table, COUNT(*) AS rows_in,
           COUNT(*) FILTER (NOT _is_quarantined) AS rows_out, COUNT(*) FILTER (_is_quarantined) AS rows_rejected,
           'merge_dedup' AS transformation_type FROM sv GROUP BY _pipeline_run_id""")
def _(t):
    counts = medallion.run_counts(_silver(t)).select(
        F.lit("orders").alias("dataset_id"),
        F.col("_pipeline_run_id").alias("pipeline_run_id"),
        moment(ORDERS_END).alias("event_at"),
        F.col("rows_merged").alias("rows_in"),
        F.col("rows_quarantined").alias("rows_rejected"),
    )
    return medallion.lineage_rows(counts, "bronze", "silver", "orders_raw", "orders_silver", "merge_dedup")


@query("lin_02_lineage_history", """
    SELECT pipeline_run_id, event_at, source_layer, rows_in, rows_out FROM v_lineage WHERE dataset_id = '10'
    ORDER BY event_at DESC, pipeline_run_id, source_layer LIMIT 50""")
def _(t):
    history = medallion.lineage_history(t["v_lineage"], "10", 50, ("pipeline_run_id", "source_layer"))
    return history.select("pipeline_run_id", "event_at", "source_layer", "rows_in", "rows_out")


@query("lin_03_gold_lineage", f"""
    WITH {SILVER}, g AS (SELECT _pipeline_run_id, COUNT(DISTINCT o_orderstatus) AS gold_rows FROM sv WHERE NOT _is_quarantined GROUP BY 1)
    SELECT sv._pipeline_run_id AS pipeline_run_id, 'SILVER' AS source_layer, 'GOLD' AS target_layer, COUNT(*) AS rows_in, ANY_VALUE(gold_rows) AS rows_out,
           CAST(0 AS BIGINT) AS rows_rejected FROM sv JOIN g ON sv._pipeline_run_id = g._pipeline_run_id GROUP BY 1""")
def _(t):
    silver = _silver(t)
    gold = medallion.gold_counts(medallion.to_gold(silver, "o_orderstatus"))
    counts = medallion.run_counts(silver).join(gold, "_pipeline_run_id").select(
        F.lit("orders").alias("dataset_id"),
        F.col("_pipeline_run_id").alias("pipeline_run_id"),
        moment(ORDERS_END).alias("event_at"),
        F.col("rows_merged").alias("rows_in"),
        F.col("gold_rows").alias("rows_out"),
        F.lit(0).cast("bigint").alias("rows_rejected"),
    )
    rows = medallion.lineage_rows(counts, "silver", "gold", "orders_silver", "orders_gold", "aggregate")
    return rows.select("pipeline_run_id", "source_layer", "target_layer", "rows_in", "rows_out", "rows_rejected")
