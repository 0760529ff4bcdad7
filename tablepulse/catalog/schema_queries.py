"""Schema inference on stringified tables, fingerprints, diffs and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.operators import schema

# A table as it would come from a file without types: everything is text.
TEXTS = {
    "event_id": "CAST(event_id AS STRING)",
    "user_id": "CAST(user_id AS STRING)",
    "value": "CAST(value AS STRING)",
    "day": "CAST(CAST(ts AS DATE) AS STRING)",
    "event_type": "event_type",
    "is_click": "CASE WHEN event_type = 'click' THEN 'yes' ELSE 'No' END",
    "props": "props",
    "nothing": "CAST(NULL AS STRING)",
}
KINDS = {
    "event_id": "NUMBER(18,0)", "user_id": "NUMBER(18,0)", "value": "FLOAT", "day": "TIMESTAMP_NTZ",
    "event_type": "VARCHAR(65535)", "is_click": "BOOLEAN", "props": "VARCHAR(65535)", "nothing": "VARCHAR(65535)",
}
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFERRED = " UNION ALL ".join(
    f"""SELECT CAST({i} AS INT) AS position, '{c}' AS column_name,
        CASE WHEN COUNT(x) = 0 THEN 'VARCHAR(65535)'
             WHEN bool_and(regexp_matches(x, '{NUMBER}')) AND bool_or(contains(x, '.')) THEN 'FLOAT'
             WHEN bool_and(regexp_matches(x, '{NUMBER}')) THEN 'NUMBER(18,0)'
             WHEN COUNT(TRY_CAST(x AS TIMESTAMP)) = COUNT(x) THEN 'TIMESTAMP_NTZ'
             WHEN bool_and(lower(x) IN ('true', 'false', '1', '0', 'yes', 'no', 't', 'f')) THEN 'BOOLEAN'
             ELSE 'VARCHAR(65535)' END AS logical_type,
        COUNT(*) > COUNT(x) AS nullable FROM (SELECT {e} AS x FROM v_events_dirty) q"""
    for i, (c, e) in enumerate(TEXTS.items())
)


def _texts(t):
    return t["v_events_dirty"].select(*[F.expr(e).alias(c) for c, e in TEXTS.items()])


def _inferred(t):
    return schema.infer_schema(_texts(t))


@query("sch_02_infer_typed_table", """
    SELECT 'event_id' AS column_name, 'NUMBER(18,0)' AS logical_type, COUNT(*) > COUNT(event_id) AS nullable FROM v_events_dirty
    UNION ALL SELECT 'ts', 'TIMESTAMP_NTZ', COUNT(*) > COUNT(ts) FROM v_events_dirty
    UNION ALL SELECT 'user_id', 'NUMBER(18,0)', COUNT(*) > COUNT(user_id) FROM v_events_dirty
    UNION ALL SELECT 'event_type', 'VARCHAR(65535)', COUNT(*) > COUNT(event_type) FROM v_events_dirty
    UNION ALL SELECT 'value', 'FLOAT', COUNT(*) > COUNT(value) FROM v_events_dirty
    UNION ALL SELECT 'props', 'VARCHAR(65535)', COUNT(*) > COUNT(props) FROM v_events_dirty""")
def _(t):
    return schema.infer_schema(t["v_events_dirty"]).select("column_name", "logical_type", "nullable")


@query("sch_03_promote_texts", INFERRED)
def _(t):
    return _inferred(t).drop("storage_type")


@query("sch_04_sample_values", """
    WITH l AS (SELECT 'user_id' AS column_name, event_id, CAST(user_id AS VARCHAR) AS v FROM v_events_dirty
               UNION ALL SELECT 'event_type', event_id, event_type FROM v_events_dirty
               UNION ALL SELECT 'value', event_id, CAST(value AS VARCHAR) FROM v_events_dirty)
    SELECT column_name, CAST(sample_no AS INT) AS sample_no, v AS sample_value FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY event_id, v) AS sample_no FROM l WHERE v IS NOT NULL) r
    WHERE sample_no <= 5""")
def _(t):
    rows = t["v_events_dirty"].select(F.col("event_id").alias("_event_id"), "user_id", "event_type", "value")
    return schema.sample_values(rows, "_event_id")


CANONICAL = "concat('[', string_agg(concat('{\"name\": \"', column_name, '\", \"type\": \"', logical_type, '\"}'), ', ' ORDER BY column_name), ']')"
VERSION_COLUMNS = """
    c AS (SELECT dataset_id, version, json_extract_string(e, '$.name') AS column_name, json_extract_string(e, '$.snowflake_type') AS logical_type
          FROM (SELECT dataset_id, version, unnest(from_json(schema_json, '["json"]')) AS e FROM v_schema_versions) s)"""


@query("sch_05_fingerprints", f"""
    WITH {VERSION_COLUMNS} SELECT dataset_id, version, left(sha256({CANONICAL}), 16) AS fingerprint FROM c GROUP BY dataset_id, version""")
def _(t):
    columns = schema.explode_schema(t["v_schema_versions"], "dataset_id", "version")
    return schema.fingerprints(columns, "dataset_id", "version")


CHANGES = f"""
    {VERSION_COLUMNS},
    o AS (SELECT dataset_id, version + 1 AS version, column_name, logical_type FROM c),
    p AS (SELECT DISTINCT dataset_id, version FROM c INTERSECT SELECT DISTINCT dataset_id, version FROM o),
    ch AS (SELECT COALESCE(n.dataset_id, o.dataset_id) AS dataset_id, COALESCE(n.version, o.version) AS version,
           COALESCE(n.column_name, o.column_name) AS column_name,
           CASE WHEN o.column_name IS NULL THEN 'ADD_COLUMN' WHEN n.column_name IS NULL THEN 'DROP_COLUMN' WHEN o.logical_type <> n.logical_type THEN 'TYPE_CHANGE' END AS change_type,
           CASE WHEN o.column_name IS NULL THEN concat(n.column_name, ' was added as ', n.logical_type)
                WHEN n.column_name IS NULL THEN concat(o.column_name, ' is missing from now on, it was ', o.logical_type)
                ELSE concat(n.column_name, ' was ', o.logical_type, ' and is ', n.logical_type) END AS detail
           FROM (SELECT * FROM c) n FULL JOIN o ON n.dataset_id = o.dataset_id AND n.version = o.version AND n.column_name = o.column_name)"""


def _changes(t):
    """Each version against the one numbered five below it, the one before of its data set."""
    new = schema.explode_schema(t["v_schema_versions"], "dataset_id", "version")
    old = new.withColumn("version", F.col("version") + 5)
    known = new.select("dataset_id", "version").distinct().join(old.select("dataset_id", "version").distinct(), ["dataset_id", "version"])
    both = [df.join(known, ["dataset_id", "version"], "left_semi") for df in (old, new)]
    return schema.schema_changes(*both, "dataset_id", "version")


_CHANGES_SQL = CHANGES.replace("version + 1", "version + 5")


@query("sch_06_schema_changes", f"""
    WITH {_CHANGES_SQL} SELECT ch.* FROM ch JOIN p ON ch.dataset_id = p.dataset_id AND ch.version = p.version WHERE change_type IS NOT NULL""")
def _(t):
    return _changes(t)


@query("jn_06_schema_diff", f"""
    WITH n AS ({INFERRED}), o AS (SELECT column_name, CASE WHEN column_name = 'value' THEN 'NUMBER(18,0)' ELSE logical_type END AS logical_type FROM n WHERE column_name <> 'props'
        UNION ALL SELECT 'gone', 'FLOAT')
    SELECT COALESCE(n.column_name, o.column_name) AS column_name,
           CASE WHEN o.column_name IS NULL THEN 'ADD_COLUMN' WHEN n.column_name IS NULL THEN 'DROP_COLUMN' ELSE 'TYPE_CHANGE' END AS change_type
    FROM n FULL JOIN o ON n.column_name = o.column_name WHERE n.logical_type IS DISTINCT FROM o.logical_type""")
def _(t):
    new = _inferred(t)
    kind = F.when(F.col("column_name") == "value", F.lit("NUMBER(18,0)")).otherwise(F.col("logical_type"))
    old = new.select("column_name", kind.alias("logical_type"))
    renamed = F.when(F.col("column_name") == "props", F.lit("gone")).otherwise(F.col("column_name"))
    retyped = F.when(F.col("column_name") == "props", F.lit("FLOAT")).otherwise(F.col("logical_type"))
    old = old.select(renamed.alias("column_name"), retyped.alias("logical_type"))
    return schema.schema_changes(old, new).drop("detail")


@query("sch_07_change_summaries", f"""
    WITH {_CHANGES_SQL} SELECT ch.dataset_id, ch.version, string_agg(concat(change_type, ': ', column_name), '; ' ORDER BY change_type = 'DROP_COLUMN', column_name) AS change_summary
    FROM ch JOIN p ON ch.dataset_id = p.dataset_id AND ch.version = p.version WHERE change_type IS NOT NULL GROUP BY ALL""")
def _(t):
    return schema.change_summaries(_changes(t), "dataset_id", "version")


@query("sch_08_schema_documents", f"""
    WITH n AS ({INFERRED})
    SELECT 'events' AS dataset_id, concat('[', string_agg(concat('{{"name":"', column_name, '","snowflake_type":"', logical_type, '","pandas_dtype":"string","nullable":', CASE WHEN nullable THEN 'true' ELSE 'false' END, '}}'), ',' ORDER BY position), ']') AS schema_json FROM n""")
def _(t):
    return schema.schema_documents(_inferred(t).withColumn("dataset_id", F.lit("events")), "dataset_id")
