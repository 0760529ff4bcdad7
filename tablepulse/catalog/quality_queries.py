"""Quality operators on the events with injected NULLs and duplicates, and on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END
from tablepulse.functions.scores import clamp_score, quality_severity
from tablepulse.functions.times import hours_since, moment
from tablepulse.operators import quality
from tablepulse.operators.relational import select_data
from tablepulse.operators.schema import explode_schema
from tablepulse.sources.registry import current_versions

# Registered types: ts is registered as text and value as a whole number type, so
# that one column is of the wrong family.
TYPES = {
    "event_id": "NUMBER(18,0)", "ts": "VARCHAR(65535)", "user_id": "NUMBER(18,0)",
    "event_type": "VARCHAR(65535)", "value": "FLOAT", "props": "VARCHAR(65535)",
}
GROUPED_TYPES = {**TYPES, "ts": "TIMESTAMP_NTZ"}
COLUMNS = list(TYPES)

# Per-column counts in long form, for the reference SQL.
LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n, COUNT(*) FILTER ({c} IS NULL) AS null_count,"
    f" {'FALSE' if c == 'ts' else 'TRUE'} AS type_ok FROM v_events_dirty"
    for c in COLUMNS
)
METRICS = f"""
    m AS (SELECT column_name, n, null_count, ROUND(null_count * 1.0e0 / n, 6) AS null_rate, type_ok,
                 CASE WHEN type_ok THEN 0 ELSE null_count END AS unexpected_count FROM ({LONG}) l)"""
DUPLICATES = f"""
    d AS (SELECT CAST(COALESCE(SUM(k) FILTER (k > 1), 0) AS BIGINT) AS duplicate_count, CAST(SUM(k) AS BIGINT) AS total_rows
          FROM (SELECT COUNT(*) AS k FROM v_events_dirty GROUP BY {', '.join(COLUMNS)}) g)"""
RATES = f"""
    r AS (SELECT d.total_rows, CAST((SELECT COUNT(*) FROM m) AS INT) AS total_columns,
                 ROUND((SELECT SUM(null_rate) FROM m) / 6, 6) AS null_rate, d.duplicate_count,
                 ROUND(d.duplicate_count * 1.0e0 / d.total_rows, 6) AS duplicate_rate,
                 ROUND((SELECT COUNT(*) FROM m WHERE NOT type_ok) / 6, 6) AS type_mismatch_rate,
                 ROUND(least((SELECT SUM(unexpected_count) FROM m) / (6.0e0 * d.total_rows), 1), 6) AS range_fail_rate,
                 ROUND((epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us((SELECT MAX(ts) FROM v_events_dirty))) / 3.6e9, 2) AS freshness_hours,
                 (SELECT COUNT(*) FILTER (null_count = 0) + COUNT(*) FILTER (type_ok) FROM m) + CASE WHEN d.duplicate_count = 0 THEN 1 ELSE 0 END AS expectations_passed,
                 CAST(13 AS BIGINT) AS expectations_total FROM d)"""
SEVERITY = """CASE WHEN quality_score >= 90 THEN 'info' WHEN quality_score >= 75 THEN 'low'
           WHEN quality_score >= 60 THEN 'medium' WHEN quality_score >= 40 THEN 'high' ELSE 'critical' END"""
SCORED = f"""
    f AS (SELECT *, ROUND(greatest(0.0e0, 1 - freshness_hours / 24), 6) AS freshness_score FROM r),
    s AS (SELECT *, ROUND(least(100.0e0, greatest(0.0e0, (1 - null_rate) * 0.3e0 * 100 + (1 - duplicate_rate) * 0.2e0 * 100
                 + (1 - type_mismatch_rate) * 0.25e0 * 100 + freshness_score * 0.15e0 * 100 + (1 - range_fail_rate) * 0.1e0 * 100)), 2) AS quality_score FROM f)"""


def _measured(t):
    return quality.measure(t["v_events_dirty"], types=TYPES, loaded_at="ts")


def _rated(t):
    return quality.rates(_measured(t), EVENTS_END)


GROUPED = f"""
    WITH base AS (SELECT event_type, COUNT(*) AS total_rows,
        COUNT(*) FILTER (event_id IS NULL) AS n1, COUNT(*) FILTER (ts IS NULL) AS n2, COUNT(*) FILTER (user_id IS NULL) AS n3,
        COUNT(*) FILTER (value IS NULL) AS n4, COUNT(*) FILTER (props IS NULL) AS n5, MAX(ts) AS latest
        FROM v_events_dirty GROUP BY event_type),
    dup AS (SELECT event_type, CAST(COALESCE(SUM(k) FILTER (k > 1), 0) AS BIGINT) AS duplicate_count FROM (
        SELECT event_type, COUNT(*) AS k FROM v_events_dirty GROUP BY {', '.join(COLUMNS)}) g GROUP BY event_type),
    r AS (SELECT base.event_type, total_rows, 5 AS total_columns,
        ROUND((ROUND(n1 * 1.0e0 / total_rows, 6) + ROUND(n2 * 1.0e0 / total_rows, 6) + ROUND(n3 * 1.0e0 / total_rows, 6)
             + ROUND(n4 * 1.0e0 / total_rows, 6) + ROUND(n5 * 1.0e0 / total_rows, 6)) / 5, 6) AS null_rate,
        duplicate_count, ROUND(duplicate_count * 1.0e0 / total_rows, 6) AS duplicate_rate,
        0.0e0 AS type_mismatch_rate, 0.0e0 AS range_fail_rate,
        ROUND((epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(latest)) / 3.6e9, 2) AS freshness_hours,
        CAST(5 + (CASE WHEN n1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n3 = 0 THEN 1 ELSE 0 END)
             + (CASE WHEN n4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN n5 = 0 THEN 1 ELSE 0 END)
             + (CASE WHEN duplicate_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS expectations_passed,
        CAST(11 AS BIGINT) AS expectations_total
        FROM base JOIN dup ON base.event_type = dup.event_type),
    {SCORED}
    SELECT *, quality_score >= 80 AS passed, {SEVERITY} AS severity FROM s"""


@query("dq_score_by_event_type", GROUPED)
def score_by_event_type(t):
    return quality.profile(t["v_events_dirty"], EVENTS_END, ["event_type"], GROUPED_TYPES, loaded_at="ts")


@query("dq_01_null_rates", f"WITH {METRICS} SELECT column_name, null_count, null_rate FROM m")
def _(t):
    return quality.column_metrics(_measured(t)).select("column_name", "null_count", "null_rate")


@query("dq_02_type_ok", f"WITH {METRICS} SELECT column_name, type_ok FROM m")
def _(t):
    return quality.column_metrics(_measured(t)).select("column_name", "type_ok")


@query("dq_02_strict_types", """
    SELECT c AS column_name, c IN ('event_type', 'props') AS type_ok
    FROM (VALUES ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props')) v(c)""")
def _(t):
    measured = quality.measure(t["v_events_dirty"], strict_types=True)
    return quality.column_metrics(measured).select("column_name", "type_ok")


@query("dq_02_unparsable_values", r"""
    SELECT COUNT(*) FILTER (source IS NOT NULL AND NOT regexp_matches(source, '^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$')) AS source_unparsable,
           COUNT(*) FILTER (lang IS NOT NULL AND lower(lang) NOT IN ('true', 'false', '1', '0', 'yes', 'no', 't', 'f')) AS lang_unparsable
    FROM documents""")
def _(t):
    return quality.run_checks(
        t["documents"], [quality.unparsable_check({"source": "FLOAT", "lang": "BOOLEAN", "doc_id": "VARCHAR"})]
    )


@query("dq_03_duplicates", f"""
    WITH {DUPLICATES} SELECT total_rows, duplicate_count, ROUND(duplicate_count * 1.0e0 / total_rows, 6) AS duplicate_rate FROM d""")
def _(t):
    return quality.duplicate_rows(t["v_events_dirty"])


@query("dq_03_duplicate_documents", """
    SELECT lang, CAST(SUM(k) AS BIGINT) AS total_rows, CAST(COALESCE(SUM(k) FILTER (k > 1), 0) AS BIGINT) AS duplicate_count,
           ROUND(COALESCE(SUM(k) FILTER (k > 1), 0) / SUM(k), 6) AS duplicate_rate
    FROM (SELECT lang, COUNT(*) AS k FROM documents GROUP BY lang, text) g GROUP BY lang""")
def _(t):
    return quality.duplicate_rows(t["documents"], ["lang"], ["text"])


@query("dq_04_freshness", f"""
    SELECT event_type, ROUND((epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(MAX(ts))) / 3.6e9, 2) AS freshness_hours
    FROM v_events_dirty GROUP BY event_type""")
def _(t):
    latest = t["v_events_dirty"].groupBy("event_type").agg(F.max("ts").alias("latest"))
    return latest.select("event_type", hours_since(F.col("latest"), moment(EVENTS_END)).alias("freshness_hours"))


@query("dq_05_expectations", f"WITH {METRICS}, {DUPLICATES}, {RATES} SELECT expectations_passed, expectations_total FROM r")
def _(t):
    return _rated(t).select("expectations_passed", "expectations_total")


@query("dq_06_unexpected_counts", f"WITH {METRICS} SELECT column_name, unexpected_count FROM m")
def _(t):
    return quality.column_metrics(_measured(t)).select("column_name", "unexpected_count")


@query("dq_07_mean_null_rate", f"WITH {METRICS}, {DUPLICATES}, {RATES} SELECT null_rate FROM r")
def _(t):
    return _rated(t).select("null_rate")


@query("dq_08_type_mismatch_rate", f"WITH {METRICS}, {DUPLICATES}, {RATES} SELECT type_mismatch_rate FROM r")
def _(t):
    return _rated(t).select("type_mismatch_rate")


@query("dq_09_range_fail_rate", f"WITH {METRICS}, {DUPLICATES}, {RATES} SELECT range_fail_rate FROM r")
def _(t):
    return _rated(t).select("range_fail_rate")


@query("dq_09_range_rules", """
    SELECT l_returnflag, COUNT(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS l_quantity_out_of_range,
           COUNT(*) FILTER (l_discount > 0.08) AS l_discount_out_of_range FROM lineitem GROUP BY l_returnflag""")
def _(t):
    rules = quality.range_check({"l_quantity": (5, 45), "l_discount": (None, 0.08)})
    return quality.run_checks(t["lineitem"], [rules], ["l_returnflag"])


@query("dq_10_freshness_score", f"""
    SELECT event_type, ROUND(greatest(0.0e0, 1 - ROUND((epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(MAX(ts))) / 3.6e9, 2) / 24), 6) AS freshness_score
    FROM v_events_dirty GROUP BY event_type""")
def _(t):
    latest = t["v_events_dirty"].groupBy("event_type").agg(F.max("ts").alias("latest"))
    hours = hours_since(F.col("latest"), moment(EVENTS_END))
    return latest.select("event_type", quality.freshness_score(hours).alias("freshness_score"))


@query("dq_11_quality_score", f"WITH {METRICS}, {DUPLICATES}, {RATES}, {SCORED} SELECT total_rows, quality_score FROM s")
def _(t):
    return quality.score(_rated(t)).select("total_rows", "quality_score")


@query("dq_12_pass_gate", f"WITH {METRICS}, {DUPLICATES}, {RATES}, {SCORED} SELECT quality_score >= 80 AS passed FROM s")
def _(t):
    return quality.score(_rated(t)).select("passed")


@query("dq_13_severity", """
    SELECT CASE WHEN v >= 90 THEN 'info' WHEN v >= 75 THEN 'low' WHEN v >= 60 THEN 'medium' WHEN v >= 40 THEN 'high' ELSE 'critical' END AS severity,
           COUNT(*) AS n FROM (SELECT least(100.0e0, greatest(0.0e0, c_acctbal / 50)) AS v FROM customer) c GROUP BY 1""")
def _(t):
    score = clamp_score(F.col("c_acctbal") / 50)
    return t["customer"].groupBy(quality_severity(score).alias("severity")).agg(F.count("*").alias("n"))


@query("dq_14_metric_rows", f"""
    WITH {METRICS}
    SELECT column_name, 'null_rate' AS metric_type, null_rate AS metric_value, 0.05e0 AS threshold, null_rate <= 0.05e0 AS passed FROM m
    UNION ALL SELECT column_name, 'type_mismatch', CASE WHEN type_ok THEN 0.0e0 ELSE 1.0e0 END, 0.01e0, type_ok FROM m""")
def _(t):
    return quality.metric_rows(quality.column_metrics(_measured(t)))


@query("dq_15_registered_types", """
    SELECT dataset_id, json_extract_string(c, '$.name') AS column_name, json_extract_string(c, '$.snowflake_type') AS logical_type
    FROM (SELECT dataset_id, unnest(from_json(arg_max(schema_json, version), '["json"]')) AS c FROM v_schema_versions GROUP BY dataset_id) s""")
def _(t):
    return explode_schema(current_versions(t["v_schema_versions"]), "dataset_id")


@query("dq_16_profile", f"""
    WITH {METRICS}, {DUPLICATES}, {RATES}, {SCORED} SELECT *, quality_score >= 80 AS passed, {SEVERITY} AS severity FROM s""")
def _(t):
    return quality.profile(t["v_events_dirty"], EVENTS_END, types=TYPES, loaded_at="ts")


@query("dq_16_daily_null_scores", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS total_rows, COUNT(*) FILTER (user_id IS NULL) AS user_id_nulls,
           COUNT(*) FILTER (value IS NULL) AS value_nulls FROM v_events_dirty GROUP BY ALL""")
def _(t):
    rows = t["v_events_dirty"].withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    nulls = quality.column_metrics(quality.measure(rows, ["day", "event_type"]), ["day", "event_type", "total_rows"])
    picked = nulls.filter(F.col("column_name").isin("user_id", "value"))
    wide = picked.groupBy("day", "event_type", "total_rows").pivot("column_name", ["user_id", "value"]).agg(F.sum("null_count"))
    return wide.select(
        "day", "event_type", "total_rows", F.col("user_id").alias("user_id_nulls"), F.col("value").alias("value_nulls")
    )


@query("ext_01_custom_checks", """
    SELECT event_type, COUNT(*) FILTER (value < 0) AS negative_values, COUNT(DISTINCT user_id) AS users,
           COUNT(*) FILTER (value > 90) + COUNT(*) FILTER (value < 1) AS value_out_of_range FROM v_events_dirty GROUP BY event_type""")
def _(t):
    def own(columns):
        return [F.count_if(F.col("value") < 0).alias("negative_values"), F.count_distinct("user_id").alias("users")]

    return quality.run_checks(t["v_events_dirty"], [own, quality.range_check({"value": (1, 90)})], ["event_type"])


@query("prj_01_data_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM v_bronze")
def _(t):
    return select_data(t["v_bronze"])
