"""Drift operators: lineitem split by ship date, events split by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepulse.catalog import query
from tablepulse.catalog.tables import EVENTS_SPLIT, LINES_SPLIT
from tablepulse.functions.scores import drift_severity
from tablepulse.operators import drift
from tablepulse.operators.relational import common_columns

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_returnflag", "l_linestatus"]
# All columns but the one that splits the windows.
COLUMNS = NUMBERS + CATEGORIES

LONG = "x AS (" + " UNION ALL ".join(
    f"SELECT l_shipdate >= TIMESTAMP '{LINES_SPLIT}' AS cur, '{c}' AS column_name, {c} AS v FROM lineitem" for c in NUMBERS
) + ")"
STATS = """
    st AS (SELECT column_name, MIN(v) AS lo, MAX(v) AS hi, COUNT(*) FILTER (cur) AS n, COUNT(*) FILTER (NOT cur) AS m FROM x GROUP BY column_name)"""
PSI = """
    b AS (SELECT x.column_name, cur, """ + " + ".join(
    f"CASE WHEN v >= (hi - lo) / 10 * {i} + lo THEN 1 ELSE 0 END" for i in range(1, 10)
) + """ AS bin FROM x JOIN st ON x.column_name = st.column_name),
    bins AS (SELECT st.column_name, r.i AS bin FROM st, range(10) r(i)),
    bc AS (SELECT bins.column_name, bins.bin, COUNT(b.bin) FILTER (cur) AS c, COUNT(b.bin) FILTER (NOT cur) AS r
           FROM bins LEFT JOIN b ON b.column_name = bins.column_name AND b.bin = bins.bin GROUP BY ALL),
    pp AS (SELECT bc.column_name, (c + 1e-6) / (n + 1e-5) AS cp, (r + 1e-6) / (m + 1e-5) AS rp FROM bc JOIN st ON bc.column_name = st.column_name),
    psi AS (SELECT column_name, ROUND(abs(SUM((cp - rp) * ln(cp / rp))), 6) AS psi FROM pp GROUP BY column_name)"""
KS = """
    vc AS (SELECT column_name, v, COUNT(*) FILTER (cur) AS c, COUNT(*) FILTER (NOT cur) AS r FROM x GROUP BY ALL),
    cum AS (SELECT column_name, SUM(c) OVER w AS sc, SUM(r) OVER w AS sr FROM vc WINDOW w AS (PARTITION BY column_name ORDER BY v)),
    ks AS (SELECT cum.column_name, MAX(abs(sc * 1.0e0 / n - sr * 1.0e0 / m)) AS d, ANY_VALUE(n) AS n, ANY_VALUE(m) AS m
           FROM cum JOIN st ON cum.column_name = st.column_name GROUP BY cum.column_name),
    kp AS (SELECT column_name, d, n, m, ROUND(d, 6) AS ks_statistic, d * sqrt(n * 1.0e0 * m / (n + m)) AS z, CAST(round(d * n * m) AS BIGINT) AS h FROM ks),
    kw AS (SELECT column_name, n, m, h, 0 AS s, 0 AS low, [1.0e0] AS paths FROM kp
           WHERE n <= 10000 AND m <= 10000 AND h > 0 AND 4 * exp(-2e0 * n * m * d * d / pow(sqrt(n) + sqrt(m), 2)) >= 1e-7
           UNION ALL SELECT column_name, n, m, h, s, low2, list_transform(range(low2, high2 + 1), lambda y:
             (coalesce(CASE WHEN y >= low THEN paths[CAST(y - low + 1 AS INT)] END, 0) * (n - s + y + 1)
              + coalesce(CASE WHEN y > low THEN paths[CAST(y - low AS INT)] END, 0) * (m - y + 1)) / (n + m - s + 1))
           FROM (SELECT column_name, n, m, h, s + 1 AS s, low, paths,
                        CAST(greatest(0, s + 1 - n, floor(((s + 1) * m - h) * 1.0e0 / (n + m)) + 1) AS INT) AS low2,
                        CAST(least(m, s + 1, ceil(((s + 1) * m + h) * 1.0e0 / (n + m)) - 1) AS INT) AS high2 FROM kw WHERE s < n + m)),
    kx AS (SELECT column_name, 1 - coalesce(paths[CAST(m - low + 1 AS INT)], 0) AS p FROM kw WHERE s = n + m),
    kq AS (SELECT kp.column_name, ks_statistic, ROUND(CASE WHEN n <= 10000 AND m <= 10000 THEN
             CASE WHEN h = 0 THEN 1.0e0 ELSE greatest(0.0e0, least(1.0e0, coalesce(kx.p, 0.0e0))) END
           WHEN z < 0.2 THEN 1.0e0 ELSE greatest(0.0e0, least(1.0e0,
           2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0e0 * k * k * z * z))))) END, 6) AS ks_p_value
           FROM kp LEFT JOIN kx ON kp.column_name = kx.column_name)"""
CATEGORY = "y AS (" + " UNION ALL ".join(
    f"SELECT l_shipdate >= TIMESTAMP '{LINES_SPLIT}' AS cur, '{c}' AS column_name, {c} AS v FROM lineitem" for c in CATEGORIES
) + """),
    cu AS (SELECT column_name, v, COUNT(*) * 1.0e0 / SUM(COUNT(*)) OVER (PARTITION BY column_name) AS p FROM y WHERE cur GROUP BY column_name, v),
    re AS (SELECT column_name, v, COUNT(*) * 1.0e0 / SUM(COUNT(*)) OVER (PARTITION BY column_name) AS p FROM y WHERE NOT cur GROUP BY column_name, v),
    sh AS (SELECT COALESCE(cu.column_name, re.column_name) AS column_name, COALESCE(cu.v, re.v) AS category,
           COALESCE(cu.p, 1e-6) AS current_share, COALESCE(re.p, 1e-6) AS reference_share
           FROM cu FULL JOIN re ON cu.column_name = re.column_name AND cu.v = re.v),
    cs AS (SELECT column_name, ROUND(SUM(abs(current_share - reference_share)), 6) AS psi FROM sh GROUP BY column_name)"""
ALL = f"""
    {LONG}, {STATS}, {PSI}, {KS}, {CATEGORY},
    a AS (SELECT psi.column_name, 'numeric' AS kind, psi, ks_statistic, ks_p_value, psi > 0.2 OR ks_p_value < 0.05 AS drift_detected
          FROM psi JOIN kq ON psi.column_name = kq.column_name
          UNION ALL SELECT column_name, 'category', psi, 0.0e0, 1.0e0, psi > 0.1 FROM cs)"""
SUMMARY = """
    u AS (SELECT CAST(COUNT(*) FILTER (drift_detected) AS BIGINT) AS drifted_columns, COUNT(*) AS total_columns,
                 ROUND(AVG(psi), 6) AS avg_psi, ROUND(AVG(ks_statistic), 6) AS avg_ks_stat FROM a),
    s AS (SELECT drifted_columns, total_columns, ROUND(drifted_columns * 1.0e0 / total_columns * 100, 2) AS drift_pct, avg_psi, avg_ks_stat,
                 ROUND(drifted_columns * 1.0e0 / total_columns, 4) AS drift_score FROM u)"""
SEVERITY = "CASE WHEN drift_pct >= 40 THEN 'high' WHEN drift_pct >= 20 THEN 'medium' ELSE 'low' END"


def _sides(t):
    return drift.split_by_time(t["lineitem"], "l_shipdate", LINES_SPLIT)


def _compared(t):
    return drift.column_drift(_sides(t), COLUMNS)


@query("dr_01_time_split", f"""
    SELECT COUNT(*) FILTER (l_shipdate >= TIMESTAMP '{LINES_SPLIT}') AS current_rows,
           COUNT(*) FILTER (l_shipdate < TIMESTAMP '{LINES_SPLIT}') AS reference_rows FROM lineitem""")
def _(t):
    return drift.side_rows(_sides(t))


@query("dr_01_newest_and_oldest", """
    SELECT TRUE AS is_current, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 300) a
    UNION ALL SELECT FALSE, COUNT(*), MIN(event_id), MAX(event_id) FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 300) b""")
def _(t):
    sides = drift.newest_and_oldest(t["events"], "ts", "event_id", n=300)
    return sides.groupBy(F.col(drift.SIDE).alias("is_current")).agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query("dr_01_two_tables", """
    SELECT 'event_id' AS column_name, (SELECT COUNT(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20') AS current_rows,
           (SELECT COUNT(*) FROM events WHERE ts < TIMESTAMP '2024-01-10') AS reference_rows""")
def _(t):
    events = t["events"]
    current, reference = events.filter(F.col("ts") >= "2024-01-20"), events.filter(F.col("ts") < "2024-01-10")
    sides = drift.pair(current.select("event_id", "props"), reference.select("event_id", "value"))
    return drift.side_rows(sides).select(F.lit(sides.columns[0]).alias("column_name"), "current_rows", "reference_rows")


@query("dr_02_enough_rows", f"""
    WITH RECURSIVE {ALL}, {SUMMARY}
    SELECT total_columns, (SELECT COUNT(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{LINES_SPLIT}') AS current_rows,
           (SELECT COUNT(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '{LINES_SPLIT}') AS reference_rows FROM s""")
def _(t):
    sides = _sides(t)
    summary = drift.drift_summary(drift.column_drift(sides, COLUMNS))
    return drift.enough_rows(summary, sides).select("total_columns", "current_rows", "reference_rows")


@query("dr_03_column_kinds", """
    SELECT * FROM (VALUES ('event_id', 'numeric'), ('user_id', 'numeric'), ('event_type', 'category'), ('value', 'numeric'), ('props', 'category')) v(column_name, kind)""")
def _(t):
    return drift.column_drift(drift.split_by_time(t["events"], "ts", EVENTS_SPLIT)).select("column_name", "kind")


@query("dr_04_psi", f"WITH RECURSIVE {LONG}, {STATS}, {PSI} SELECT column_name, psi FROM psi")
def _(t):
    return drift.numeric_drift(_sides(t), NUMBERS).select("column_name", "psi")


@query("dr_05_ks_statistic", f"WITH RECURSIVE {LONG}, {STATS}, {KS} SELECT column_name, ks_statistic FROM kq")
def _(t):
    return drift.numeric_drift(_sides(t), NUMBERS).select("column_name", "ks_statistic")


@query("dr_06_ks_p_value", f"WITH RECURSIVE {LONG}, {STATS}, {KS} SELECT column_name, ks_p_value FROM kq")
def _(t):
    return drift.numeric_drift(_sides(t), NUMBERS).select("column_name", "ks_p_value")


BALANCES_LONG = """x AS (SELECT c_mktsegment = 'BUILDING' AS cur, 'balances_' || c_nationkey % 5 AS column_name, c_acctbal AS v FROM customer)"""


@query("dr_06_small_windows", f"WITH RECURSIVE {BALANCES_LONG}, {STATS}, {KS} SELECT column_name, ks_statistic, ks_p_value FROM kq")
def _(t):
    """Balances of one market segment against all others, a comparison per group of nations: some dozen rows against more."""
    groups = [f"balances_{i}" for i in range(5)]
    balances = [F.when(F.col("c_nationkey") % 5 == i, F.col("c_acctbal")).alias(name) for i, name in enumerate(groups)]
    sides = t["customer"].select((F.col("c_mktsegment") == "BUILDING").alias(drift.SIDE), *balances)
    return drift.numeric_drift(sides, groups).select("column_name", "ks_statistic", "ks_p_value")


@query("dr_07_category_shift", f"WITH {CATEGORY} SELECT column_name, psi AS shift FROM cs")
def _(t):
    return drift.categorical_drift(_sides(t), CATEGORIES).select("column_name", F.col("psi").alias("shift"))


@query("dr_08_verdicts", f"WITH RECURSIVE {ALL} SELECT column_name, drift_detected FROM a")
def _(t):
    return _compared(t).select("column_name", "drift_detected")


@query("dr_09_summary", f"WITH RECURSIVE {ALL}, {SUMMARY} SELECT drifted_columns, total_columns, drift_pct, avg_psi, avg_ks_stat FROM s")
def _(t):
    return drift.drift_summary(_compared(t)).select("drifted_columns", "total_columns", "drift_pct", "avg_psi", "avg_ks_stat")


@query("dr_10_score", f"WITH RECURSIVE {ALL}, {SUMMARY} SELECT drift_score, drift_pct > 0 AS drift_detected FROM s")
def _(t):
    return drift.drift_summary(_compared(t)).select("drift_score", "drift_detected")


@query("dr_11_severity", """
    SELECT event_id, CASE WHEN value >= 40 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity FROM events""")
def _(t):
    return t["events"].select("event_id", drift_severity(F.col("value")).alias("severity"))


@query("dr_12_metric_rows", f"""
    WITH RECURSIVE {ALL} SELECT column_name, 'ks_test+psi' AS drift_method, ks_statistic AS statistic_value, ks_p_value AS p_value,
    psi AS psi_score, drift_detected, CASE WHEN drift_detected THEN 'HIGH' ELSE 'LOW' END AS severity FROM a""")
def _(t):
    return drift.drift_metric_rows(_compared(t))


@query("dr_13_drift_run", f"""
    WITH RECURSIVE {ALL}, {SUMMARY} SELECT *, drift_pct > 0 AS drift_detected, {SEVERITY} AS drift_severity FROM s""")
def _(t):
    return drift.drift_summary(_compared(t))


def _events_sql():
    """The same comparison for the events with NULLs in them."""
    split = f"ts >= TIMESTAMP '{EVENTS_SPLIT}'"
    sql = f"WITH RECURSIVE {LONG}, {STATS}, {PSI}, {KS} SELECT psi.column_name, psi, ks_statistic, ks_p_value FROM psi JOIN kq ON psi.column_name = kq.column_name"
    long = "x AS (" + " UNION ALL ".join(
        f"SELECT {split} AS cur, '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM v_events_dirty WHERE {c} IS NOT NULL" for c in ("user_id", "value")
    ) + ")"
    return sql.replace(LONG, long)


@query("dr_13_events_with_nulls", _events_sql())
def _(t):
    sides = drift.split_by_time(t["v_events_dirty"], "ts", EVENTS_SPLIT)
    return drift.numeric_drift(sides, ["user_id", "value"]).select("column_name", "psi", "ks_statistic", "ks_p_value")


@query("win_01_range_running_sums", f"""
    WITH {LONG}, {STATS}, {KS} SELECT vc.column_name, COUNT(*) AS distinct_values, CAST(SUM(c) AS BIGINT) AS current_rows, CAST(SUM(r) AS BIGINT) AS reference_rows
    FROM vc GROUP BY vc.column_name""")
def _(t):
    counts = drift.value_counts(drift.long_numbers(_sides(t), NUMBERS))
    distinct = counts.groupBy("column_id").agg(F.count("*").alias("distinct_values"))
    summed = drift.range_summaries(counts).groupBy("column_id").agg(
        F.sum("current_n").alias("current_rows"), F.sum("reference_n").alias("reference_rows")
    )
    name = F.element_at(F.array(*[F.lit(c) for c in NUMBERS]), F.col("column_id") + 1)
    return summed.join(distinct, "column_id").select(name.alias("column_name"), "distinct_values", "current_rows", "reference_rows")


@query("jn_07_category_shares", f"WITH {CATEGORY} SELECT category, ROUND(current_share, 6) AS current_share, ROUND(reference_share, 6) AS reference_share FROM sh")
def _(t):
    shares = drift.category_shares(_sides(t), CATEGORIES)
    return shares.select("category", F.round("current_share", 6).alias("current_share"), F.round("reference_share", 6).alias("reference_share"))


@query("prj_02_common_columns", f"""
    SELECT event_id, user_id, event_type, ts >= TIMESTAMP '{EVENTS_SPLIT}' AS is_current FROM events""")
def _(t):
    events = t["events"]
    late = F.col("ts") >= EVENTS_SPLIT
    sides = drift.pair(events.filter(late).drop("props", "ts"), events.filter(~late).drop("value", "ts"))
    assert sides.columns[:-1] == common_columns(events.drop("props", "ts"), events.drop("value", "ts"))
    return sides.withColumnRenamed(drift.SIDE, "is_current")


@query("ext_02_own_metric", f"""
    WITH {LONG}, {STATS}, {PSI} SELECT column_name, ROUND(SUM(abs(cp - rp)), 6) AS distance FROM pp GROUP BY column_name""")
def _(t):
    def distance(summaries):
        pooled = summaries.groupBy("column_id", "bin_no").agg(
            F.sum("current_n").alias("c"), F.sum("reference_n").alias("r"), F.max("current_total").alias("n"), F.max("reference_total").alias("m")
        )
        gap = F.abs((F.col("c") + 1e-6) / (F.col("n") + 1e-5) - (F.col("r") + 1e-6) / (F.col("m") + 1e-5))
        return pooled.groupBy("column_id").agg(F.round(F.sum(gap), 6).alias("distance"))

    return drift.own_metric(_sides(t), NUMBERS, distance)
