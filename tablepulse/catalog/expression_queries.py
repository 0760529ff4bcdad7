"""Column expressions over texts, times and numbers of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_END, ORDERS_END
from tablepulse.functions import names, scores, times, types

CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"""


def _clean_sql(x):
    c = CLEAN.format(x=x)
    return f"CASE WHEN {c} = '' THEN 'col_7' WHEN regexp_matches({c}, '^[0-9]') THEN concat('col_', {c}) ELSE {c} END"


@query("fn_01_clean_names", f"""
    SELECT url AS name, {_clean_sql('url')} AS clean FROM pages
    UNION ALL SELECT source, {_clean_sql('source')} FROM documents
    UNION ALL SELECT substr(props, 6, 4), {_clean_sql('substr(props, 6, 4)')} FROM events""")
def _(t):
    raw = (
        t["pages"].select(F.col("url").alias("name"))
        .union(t["documents"].select("source"))
        .union(t["events"].select(F.substring("props", 6, 4)))
    )
    return raw.select("name", names.clean_name(F.col("name"), 7).alias("clean"))


@query("fn_02_snake_names", "SELECT p_name AS name, translate(lower(trim(p_name)), ' -', '__') AS clean FROM part")
def _(t):
    return t["part"].select(F.col("p_name").alias("name"), names.snake_name(F.col("p_name")).alias("clean"))


@query("fn_03_layer_names", """
    WITH b AS (SELECT c_name, concat(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '_raw') AS bronze FROM customer),
    s AS (SELECT *, concat(regexp_replace(bronze, '_raw$', ''), '_silver') AS silver FROM b)
    SELECT *, concat(regexp_replace(silver, '_silver$', ''), '_gold') AS gold FROM s""")
def _(t):
    return (
        t["customer"].select("c_name", names.bronze_name(F.col("c_name")).alias("bronze"))
        .withColumn("silver", names.silver_name(F.col("bronze")))
        .withColumn("gold", names.gold_name(F.col("silver")))
    )


TYPE_NAMES = """
    WITH k AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'NUMBER(18,0)' WHEN '2-HIGH' THEN 'varchar(65535)'
                      WHEN '3-MEDIUM' THEN 'TIMESTAMP_NTZ' WHEN '5-LOW' THEN 'boolean' ELSE 'VARIANT' END AS type_name FROM orders)"""


def _type_names(t):
    kinds = {"1-URGENT": "NUMBER(18,0)", "2-HIGH": "varchar(65535)", "3-MEDIUM": "TIMESTAMP_NTZ", "5-LOW": "boolean"}
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("o_orderpriority")), F.lit("VARIANT"))
    return t["orders"].select("o_orderkey", name.alias("type_name"))


@query("fn_04_numeric_type_names", TYPE_NAMES + """
    SELECT o_orderkey, regexp_matches(upper(type_name), 'NUMBER|FLOAT|INT|DECIMAL|NUMERIC') AS is_numeric FROM k""")
def _(t):
    return _type_names(t).select("o_orderkey", types.is_numeric_name(F.col("type_name")).alias("is_numeric"))


@query("fn_05_type_families", TYPE_NAMES + """
    SELECT o_orderkey, CASE type_name WHEN 'NUMBER(18,0)' THEN 'numeric' WHEN 'varchar(65535)' THEN 'string'
           WHEN 'TIMESTAMP_NTZ' THEN 'date' WHEN 'boolean' THEN 'bool' ELSE 'unknown' END AS family FROM k""")
def _(t):
    return _type_names(t).select("o_orderkey", types.type_family(F.col("type_name")).alias("family"))


@query("fn_06_row_keys", """
    SELECT event_id, md5(concat_ws('|', strftime(CASE WHEN event_id % 20 = 0 THEN NULL ELSE ts END, '%Y-%m-%d %H:%M:%S.%g'), CAST(event_id AS VARCHAR))) AS row_key FROM events""")
def _(t):
    ts = F.when(F.col("event_id") % 20 != 0, F.col("ts"))
    return t["events"].select("event_id", names.row_key(ts, F.col("event_id")).alias("row_key"))


@query("fn_07_short_hashes", "SELECT doc_id, left(sha256(text), 16) AS digest FROM documents")
def _(t):
    return t["documents"].select("doc_id", names.short_hash(F.col("text")).alias("digest"))


@query("fn_08_seconds_between", f"""
    SELECT id, date_diff('second', started_at, COALESCE(completed_at, TIMESTAMP '{ORDERS_END}')) AS seconds FROM v_runs""")
def _(t):
    end = F.coalesce("completed_at", times.moment(ORDERS_END))
    return t["v_runs"].select("id", times.seconds_between(F.col("started_at"), end).alias("seconds"))


@query("fn_09_hours_since", f"""
    SELECT event_id, ROUND((epoch_us(TIMESTAMP '{EVENTS_END}') - epoch_us(ts)) / 3.6e9, 2) AS hours FROM events""")
def _(t):
    return t["events"].select("event_id", times.hours_since(F.col("ts"), times.moment(EVENTS_END)).alias("hours"))


@query("fn_10_clamped_scores", "SELECT c_custkey, greatest(0.0e0, least(100.0e0, c_acctbal / 50)) AS score FROM customer")
def _(t):
    return t["customer"].select("c_custkey", scores.clamp_score(F.col("c_acctbal") / 50).alias("score"))


@query("fn_11_labels", "SELECT id, COALESCE(silver_table, dataset_id, 'unknown') AS label FROM v_quality")
def _(t):
    return t["v_quality"].select("id", names.label("silver_table", "dataset_id").alias("label"))


@query("fn_12_json_values", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events""")
def _(t):
    parsed = F.from_json("props", "k bigint")
    return t["events"].select(
        "event_id", parsed["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("valid")
    )


@query("fn_13_health_labels", """
    SELECT event_id, CASE WHEN value >= 85 THEN 'Excellent' WHEN value >= 70 THEN 'Good' WHEN value >= 50 THEN 'Fair' WHEN value IS NULL THEN NULL ELSE 'At Risk' END AS label
    FROM v_events_dirty""")
def _(t):
    return t["v_events_dirty"].select("event_id", scores.health_label(F.col("value")).alias("label"))


@query("fn_14_bands", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'low' WHEN l_quantity < 15 THEN 'medium' ELSE 'high' END AS rate,
           CASE WHEN l_discount * 3 < 0.1 THEN 'stable' WHEN l_discount * 3 < 0.2 THEN 'moderate' ELSE 'significant' END AS psi FROM lineitem""")
def _(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber",
        scores.rate_band(F.col("l_quantity")).alias("rate"), scores.psi_band(F.col("l_discount") * 3).alias("psi"),
    )


@query("fn_16_run_labels", "SELECT id, concat(dag_id, ' · ', right(run_id, 8)) AS label FROM v_runs")
def _(t):
    return t["v_runs"].select("id", names.run_label(F.col("dag_id"), F.col("run_id")).alias("label"))


@query("fn_17_tolerant_conversion", """
    SELECT doc_id, TRY_CAST(source AS DOUBLE) AS source_number, TRY_CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS n_chars FROM documents""")
def _(t):
    return t["documents"].select(
        "doc_id",
        types.to_double(F.col("source")).alias("source_number"),
        types.to_double(F.col("n_chars").cast("string")).alias("n_chars"),
    )


@query("fn_17_time_texts", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(t):
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("at "), F.col("ts").cast("string")))
        .when(F.col("event_type") == "view", F.date_format("ts", "MM/dd/yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return t["events"].select("event_id", types.parse_time(text).cast("timestamp_ntz").alias("parsed"))
