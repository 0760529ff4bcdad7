"""Drift between a reference and a current window, exact and over whole tables.

A *sides* frame holds the rows of both windows with the flag ``_is_current``.
All columns, numbers and categories, are brought into one long form (column, value,
category) and counted per distinct value by one scan.  The counts of a column are cut
into ranges of about equal size, more of them the more distinct values it has.  Running
sums are taken inside a range only; one summary row per range then carries the totals of
the ranges before it.  No task therefore holds more than one range of a column, however
many rows a column or a single value has.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepulse.config import DriftConfig
from tablepulse.functions.keys import compact_key
from tablepulse.functions.scores import drift_severity
from tablepulse.functions.times import moment
from tablepulse.operators.relational import common_columns, data_columns

SIDE = "_is_current"
METHOD = "ks_test+psi"
# Range limits of 8 bytes that one broadcast may hold over all columns.
LIMITS_IN_BROADCAST = 1 << 22
# Values that are the same in all rows of one column.
COLUMN_FACTS = ["low", "high", "current_total", "reference_total"]
# Values per range from which one is placed as a limit.
PICKS_PER_RANGE = 8


# --- windows -----------------------------------------------------------------

def split_by_time(df: DataFrame, ts: str, split: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both windows from one scan: rows before ``split`` are the reference.

    Rows without a time belong to neither; :func:`undated_rows` counts them.
    """
    kind = df.schema[ts].dataType
    rows = df.filter(F.col(ts).isNotNull())
    if start is not None:
        rows = rows.filter(F.col(ts) >= moment(start, kind))
    if end is not None:
        rows = rows.filter(F.col(ts) < moment(end, kind))
    return rows.withColumn(SIDE, F.col(ts) >= moment(split, kind))


def undated_rows(df: DataFrame, ts: str) -> DataFrame:
    """Number of rows that no window by time can hold."""
    return df.agg(F.count_if(F.col(ts).isNull()).alias("undated_rows"))


def pair(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Windows that come from two tables; only common columns are kept.

    A column that is numeric on one side only is compared as text.
    """
    columns = common_columns(current, reference)

    def side(df: DataFrame, other: DataFrame, flag: bool) -> DataFrame:
        out = []
        for c in columns:
            same = is_numeric(df.schema[c].dataType) == is_numeric(other.schema[c].dataType)
            out.append(F.col(c) if same else F.col(c).cast("string").alias(c))
        return df.select(*out, F.lit(flag).alias(SIDE))

    return side(current, reference, True).unionByName(side(reference, current, False))


def newest_and_oldest(df: DataFrame, ts: str, *ties: str, n: int) -> DataFrame:
    """The ``n`` newest rows against the ``n`` oldest ones."""
    return pair(df.orderBy(F.desc(ts), *[F.desc(t) for t in ties]).limit(n), df.orderBy(ts, *ties).limit(n))


# First and last time of both windows in the drift facts.
WINDOW_LIMITS = ["reference_window_start", "reference_window_end", "current_window_start", "current_window_end"]


def side_rows(sides: DataFrame, ts: str | None = None) -> DataFrame:
    """Rows of both sides; with a time column also the first and last time on each, by the same scan."""
    measures = [F.count_if(F.col(SIDE)).alias("current_rows"), F.count_if(~F.col(SIDE)).alias("reference_rows")]
    if ts is not None:
        at = F.col(ts).cast("timestamp_ntz")
        sides_of = [F.when(~F.col(SIDE), at), F.when(F.col(SIDE), at)]
        found = [end(side) for side in sides_of for end in (F.min, F.max)]
        measures += [column.alias(name) for name, column in zip(WINDOW_LIMITS, found)]
    return sides.agg(*measures)


# --- long form ---------------------------------------------------------------

def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def column_kinds(sides: DataFrame, columns: Sequence[str] | None = None, times: str = "skip") -> dict[str, str]:
    """``numeric`` or ``category`` per data column.

    Times are left out, or compared as numbers (``epoch``) or as text (``category``).
    """
    kinds = {}
    for name in columns or data_columns(sides):
        data_type = sides.schema[name].dataType
        if is_numeric(data_type):
            kinds[name] = "numeric"
        elif is_time(data_type) and times != "category":
            if times == "epoch":
                kinds[name] = "numeric"
        else:
            kinds[name] = "category"
    return kinds


def _number(sides: DataFrame, name: str) -> Column:
    column, data_type = F.col(f"`{name}`"), sides.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        column = column.cast("int")
    elif is_time(data_type):
        column = F.unix_micros(column.cast("timestamp")) / 1e6
    return column.cast("double")


def _category(sides: DataFrame, name: str) -> Column:
    """Text of a category; a long text is represented by its digest."""
    column, data_type = F.col(f"`{name}`"), sides.schema[name].dataType
    if is_time(data_type) or is_numeric(data_type):
        return column.cast("string")
    return compact_key(column, data_type)


def long_cells(sides: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(side, column position, value, category) without NULL and NaN; a cell has one of value and category."""
    cells = []
    for i, (name, kind) in enumerate(kinds.items()):
        number = _number(sides, name) if kind == "numeric" else F.lit(None).cast("double")
        text = _category(sides, name) if kind == "category" else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("column_id"), number.alias("value"), text.alias("category")))
    found = (F.col("value").isNotNull() & ~F.isnan("value")) | F.col("category").isNotNull()
    return sides.select(SIDE, F.inline(F.array(*cells))).filter(found)


def long_numbers(sides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells of numeric columns."""
    return long_cells(sides, dict.fromkeys(columns, "numeric"))


def _side_counts() -> list[Column]:
    return [
        F.count_if(F.col(SIDE)).alias("current_n"),
        F.count_if(~F.col(SIDE)).alias("reference_n"),
    ]


# --- counts and ranges -------------------------------------------------------

def fit_ranges(columns: Sequence[str], config: DriftConfig) -> DriftConfig:
    """Fewer ranges at most for very wide tables, so that the broadcast limits stay below 32 MB."""
    bits = config.range_bits
    while bits > 1 and len(columns) << bits > LIMITS_IN_BROADCAST:
        bits -= 1
    return replace(config, range_bits=bits)


def value_counts(long: DataFrame) -> DataFrame:
    """Rows of both sides per column and distinct value or category.

    The one pass over the table: everything after it works on these counts.
    """
    return long.groupBy("column_id", "value", "category").agg(*_side_counts())


def column_facts(counts: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """One row per column: smallest and largest value, rows per side, number of ranges and their limits.

    A column has one range per ``config.range_values`` distinct values, ``2 ** config.range_bits`` at most.
    The limits only decide which task handles a value, so they are estimated from a part of
    the distinct values, told by their hash: some per range, and one for each of four times as many
    slots as there may be ranges.  The slots are summed in the tasks before they meet, so the
    task that sorts a column's picks receives a bounded number of rows.
    """
    most = 2**config.range_bits
    mixed = F.xxhash64("value", "category")
    every = max(1, config.range_values // PICKS_PER_RANGE)
    # In whole numbers: a double would drop the low bits of the hash, and most slots would stay empty.
    part = F.call_function("div", mixed, F.lit(every))
    slot = F.when((F.pmod(mixed, F.lit(every)) == 0) & F.col("value").isNotNull(), F.pmod(part, F.lit(4 * most)))
    slots = counts.groupBy("column_id", slot.alias("slot")).agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.sum("current_n").alias("current_total"),
        F.sum("reference_n").alias("reference_total"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min_by("value", mixed).alias("pick"),
    )
    picks = F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.col("pick"))))
    facts = slots.groupBy("column_id").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("current_total").alias("current_total"),
        F.sum("reference_total").alias("reference_total"),
        F.least(F.lit(most), F.ceil(F.sum("distinct_values") / config.range_values)).cast("int").alias("ranges"),
        picks.alias("picks"),
    )
    steps = F.slice(F.sequence(F.lit(0), F.col("ranges") - 1), F.lit(2), F.col("ranges"))
    # As bigint: both factors may reach a million.
    place = lambda i: F.floor(i.cast("bigint") * F.size("picks") / F.col("ranges")).cast("int")
    limits = F.transform(steps, lambda i: F.get("picks", place(i)))
    return facts.withColumn("limits", F.array_distinct(limits)).drop("picks")


def _with_range_no(placed: DataFrame, config: DriftConfig) -> DataFrame:
    """Adds ``range_no``: the number of limits below a value, by search; categories are dealt out by hash."""
    placed = placed.withColumn("range_no", F.lit(0))
    # One limit a step: with more, the method that Spark generates for all steps exceeds the 8,000 bytes
    # up to which the JVM compiles a method, and every row is interpreted.
    for step in (2**bit for bit in reversed(range(config.range_bits))):
        placed = placed.withColumn("range_no", F.expr(f"range_no + {step} * int(coalesce(get(limits, range_no + {step - 1}) < value, false))"))
    dealt = F.pmod(F.xxhash64("category"), F.col("ranges")).cast("int")
    return placed.withColumn("range_no", F.when(F.col("category").isNotNull(), dealt).otherwise(F.col("range_no")))


def _bin_no(config: DriftConfig) -> Column:
    """Equal-width bin, counted by the inner edges that the value reaches."""
    edges = [f"int(value >= (high - low) / {config.bins} * {i} + low)" for i in range(1, config.bins)]
    return F.expr(" + ".join(edges))


def _share(side: str, config: DriftConfig) -> Column:
    """Share of a category on one side; a missing one counts as epsilon."""
    n = F.col(f"{side}_n")
    return F.when(n > 0, n / F.col(f"{side}_total")).otherwise(config.epsilon)


def range_summaries(counts: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """Per column, range and bin: counts of both sides, the extremes of the local difference and of categories
    the sum of share differences.

    The column facts, one row per compared column, come from the same counts; Spark
    shuffles the counts once and reads them twice.
    """
    facts = column_facts(counts, config)
    shift = F.when(F.col("category").isNotNull(), F.abs(_share("current", config) - _share("reference", config)))
    placed = (
        _with_range_no(counts.join(F.broadcast(facts), "column_id"), config)
        .withColumns({"bin_no": _bin_no(config), "shift": shift})
        .select("column_id", "range_no", "bin_no", "value", "current_n", "reference_n", "shift", *COLUMN_FACTS)
    )
    running = Window.partitionBy("column_id", "range_no").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.try_divide(F.sum("current_n").over(running), F.col("current_total")) - F.try_divide(
        F.sum("reference_n").over(running), F.col("reference_total")
    )
    return (
        placed.withColumn("gap", gap)
        .groupBy("column_id", "range_no", "bin_no")
        .agg(
            *_same(COLUMN_FACTS),
            F.sum("current_n").alias("current_n"),
            F.sum("reference_n").alias("reference_n"),
            F.max("gap").alias("gap_high"),
            F.min("gap").alias("gap_low"),
            F.sum("shift").alias("shift"),
        )
    )


def _same(names: Sequence[str]) -> list[Column]:
    """Values that all rows of a group share."""
    return [F.max(name).alias(name) for name in names]


def _bin_counts(side: str, config: DriftConfig) -> Column:
    """Rows of one side per bin, bins without rows included."""
    bins = ", ".join(f"sum(if(bin_no = {i}, {side}_n, 0))" for i in range(config.bins))
    return F.expr(f"array({bins})").alias(f"{side}_bins")


def _psi(config: DriftConfig) -> Column:
    def part(n: Column, total: str) -> Column:
        return (n + config.epsilon) / (F.col(total) + config.epsilon * config.bins)

    def term(current: Column, reference: Column) -> Column:
        c, r = part(current, "current_total"), part(reference, "reference_total")
        return (c - r) * F.ln(c / r)

    terms = F.zip_with("current_bins", "reference_bins", term)
    total = F.round(F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)), 6)
    empty = (F.col("current_total") == 0) | (F.col("reference_total") == 0) | (F.col("low") == F.col("high"))
    return F.when(empty, 0.0).otherwise(total)


def ks_exact_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value of small samples: the chance that a random order of all rows does as much.

    An order of ``n`` and ``m`` rows is a path of ``n + m`` steps to the corner ``(n, m)``; its statistic is
    below the given one while it stays inside a band around the diagonal.  After each step the array
    holds, for every place of the band that has ``y`` of the ``m`` rows, the chance of having come
    there without leaving.  One row per column is computed so; the work is ``n + m`` times the width
    of the band.  Statistics so large that the p-value is 0 to 6 digits by the bound of Dvoretzky,
    Kiefer and Wolfowitz on both samples are not walked, so the band stays below a tenth of a
    side of 10,000 rows.
    """
    n, m = n.cast("bigint"), m.cast("bigint")
    both = n + m
    limit = F.round(statistic * n * m).cast("bigint")
    at_most = 4 * F.exp(-2.0 * n * m * statistic * statistic / F.pow(F.sqrt(n) + F.sqrt(m), F.lit(2.0)))

    def step(state: Column, done: Column) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), done - n, F.floor((done * m - limit) / both) + 1)
        high = F.least(m, done, F.ceil((done * m + limit) / both) - 1)
        chance = lambda y: F.coalesce(F.get(state["inside"], (y - state["low"]).cast("int")), F.lit(0.0))
        come = lambda y: (chance(y) * (n - done + y + 1) + chance(y - 1) * (m - y + 1)) / (both - done + 1)
        inside = F.when(low <= high, F.transform(F.sequence(low, high), come)).otherwise(F.array().cast("array<double>"))
        return F.struct(low.alias("low"), inside.alias("inside"))

    begin = F.struct(F.lit(0).cast("bigint").alias("low"), F.array(F.lit(1.0)).alias("inside"))
    stayed = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), both), begin, step,
        lambda state: F.coalesce(F.get(state["inside"], (m - state["low"]).cast("int")), F.lit(0.0)),
    )
    walked = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - stayed))
    return F.round(F.when(limit == 0, 1.0).when(at_most < 1e-7, 0.0).otherwise(walked), 6)


def ks_p_value(statistic: Column, n: Column, m: Column, exact_rows: int = 10_000) -> Column:
    """Two-sided p-value: exact up to ``exact_rows`` rows a side, else from the limiting distribution.

    The series needs many terms near 0; below 0.2 its value is 1 to 12 digits.
    """
    small = (n <= exact_rows) & (m <= exact_rows)
    return F.when(small, ks_exact_p_value(statistic, n, m)).otherwise(_ks_limit_p_value(statistic, n, m))


def _ks_limit_p_value(statistic: Column, n: Column, m: Column) -> Column:
    n, m = n.cast("double"), m.cast("double")  # the product of two row counts exceeds a bigint
    scaled = statistic * F.sqrt(n * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * scaled * scaled),
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series))
    return F.round(F.when(scaled < 0.2, 1.0).otherwise(bounded), 6)


def _compared(sides: DataFrame, kinds: Mapping[str, str], config: DriftConfig) -> DataFrame:
    """PSI, Kolmogorov-Smirnov statistic and p-value of numbers, sum of absolute share differences of categories."""
    found = _with_numbers(sides, kinds, config) if "numeric" in kinds.values() else _categories_only(sides, kinds, config)
    psi, ks, p = F.coalesce("psi", F.lit(0.0)), F.coalesce("ks", F.lit(0.0)), F.coalesce("p", F.lit(1.0))
    shifted = (psi > config.psi_threshold) | (p < config.p_value_threshold)
    return _named(sides, kinds).join(F.broadcast(found), "column_id", "left").select(
        "column_name",
        "kind",
        psi.alias("psi"),
        ks.alias("ks_statistic"),
        p.alias("ks_p_value"),
        F.when(F.col("kind") == "numeric", shifted).otherwise(psi > config.categorical_threshold).alias("drift_detected"),
    )


def _categories_only(sides: DataFrame, kinds: Mapping[str, str], config: DriftConfig) -> DataFrame:
    """Without numbers there is nothing to sort, so no ranges are needed."""
    shift = F.sum(F.abs(F.col("current_share") - F.col("reference_share")))
    found = category_shares(sides, list(kinds), config).groupBy("column_id").agg(F.round(shift, 6).alias("psi"))
    return found.withColumns({"ks": F.lit(0.0), "p": F.lit(1.0)})


def _with_numbers(sides: DataFrame, kinds: Mapping[str, str], config: DriftConfig) -> DataFrame:
    summaries = range_summaries(value_counts(long_cells(sides, kinds)), fit_ranges(list(kinds), config))

    # At most one row per column, range and bin reaches this window.
    before = Window.partitionBy("column_id").orderBy("range_no").rangeBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(
        F.try_divide(F.sum("current_n").over(before), F.col("current_total"))
        - F.try_divide(F.sum("reference_n").over(before), F.col("reference_total")),
        F.lit(0.0),
    )
    gap = F.greatest(F.abs(F.col("offset") + F.col("gap_high")), F.abs(F.col("offset") + F.col("gap_low")))
    merged = (
        summaries.withColumn("offset", offset)
        .groupBy("column_id")
        .agg(
            F.max(gap).alias("gap"),
            F.round(F.sum("shift"), 6).alias("shift"),
            *_same(COLUMN_FACTS),
            _bin_counts("current", config),
            _bin_counts("reference", config),
        )
    )
    number = F.col("low").isNotNull()
    enough = number & (F.col("current_total") >= 2) & (F.col("reference_total") >= 2)
    p = ks_p_value(F.col("raw_ks"), F.col("current_total"), F.col("reference_total"), config.exact_rows)
    return (
        merged.withColumn("raw_ks", F.when(enough, F.col("gap")).otherwise(0.0))
        .withColumn("p", F.when(enough, p).otherwise(1.0))
        .select("column_id", F.when(number, _psi(config)).otherwise(F.col("shift")).alias("psi"), F.round("raw_ks", 6).alias("ks"), "p")
    )


def numeric_drift(sides: DataFrame, columns: Sequence[str], config: DriftConfig = DriftConfig()) -> DataFrame:
    """PSI, Kolmogorov-Smirnov statistic and p-value of every numeric column."""
    return _compared(sides, dict.fromkeys(columns, "numeric"), config)


def categorical_drift(sides: DataFrame, columns: Sequence[str], config: DriftConfig = DriftConfig()) -> DataFrame:
    """Sum of absolute share differences of every categorical column."""
    return _compared(sides, dict.fromkeys(columns, "category"), config)


def own_metric(
    sides: DataFrame,
    columns: Sequence[str],
    metric: Callable[[DataFrame], DataFrame],
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """A metric of the caller on the counts per column, range and bin.

    ``metric`` maps the summaries to one row per ``column_id``.
    """
    found = metric(range_summaries(value_counts(long_numbers(sides, columns)), fit_ranges(columns, config)))
    return _named(sides, dict.fromkeys(columns, "numeric")).join(found, "column_id", "left").drop("column_id", "kind")


def _named(sides: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Position, name and kind of the compared columns."""
    rows = [
        F.struct(F.lit(i).alias("column_id"), F.lit(name).alias("column_name"), F.lit(kind).alias("kind"))
        for i, (name, kind) in enumerate(kinds.items())
    ]
    return sides.sparkSession.range(1).select(F.inline(F.array(*rows)))


def category_shares(sides: DataFrame, columns: Sequence[str], config: DriftConfig = DriftConfig()) -> DataFrame:
    """Share of each category on both sides; a missing one counts as epsilon.

    One grouped count covers the union of both category sets, in place of a full
    outer join of two counts.  The totals have one row per column.
    """
    counts = value_counts(long_cells(sides, dict.fromkeys(columns, "category")))
    totals = counts.groupBy("column_id").agg(
        F.sum("current_n").alias("current_total"), F.sum("reference_n").alias("reference_total")
    )
    return counts.join(F.broadcast(totals), "column_id").select(
        "column_id", "category", _share("current", config).alias("current_share"), _share("reference", config).alias("reference_share")
    )


# --- whole table -------------------------------------------------------------

def column_drift(
    sides: DataFrame,
    columns: Sequence[str] | None = None,
    times: str = "skip",
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """One row per compared column; numbers and categories are counted by the same scan."""
    kinds = column_kinds(sides, columns, times)
    if not kinds:
        raise ValueError("no column to compare")
    return _compared(sides, kinds, config)


def drift_metric_rows(columns: DataFrame) -> DataFrame:
    """Column results in the shape of the drift metric table."""
    return columns.select(
        "column_name",
        F.lit(METHOD).alias("drift_method"),
        F.col("ks_statistic").alias("statistic_value"),
        F.col("ks_p_value").alias("p_value"),
        F.col("psi").alias("psi_score"),
        "drift_detected",
        F.when(F.col("drift_detected"), F.lit("HIGH")).otherwise(F.lit("LOW")).alias("severity"),
    )


def drift_summary(columns: DataFrame) -> DataFrame:
    """Table-level roll-up of the column results."""
    drifted = F.count_if(F.col("drift_detected"))
    totals = columns.agg(
        drifted.alias("drifted_columns"),
        F.count(F.lit(1)).alias("total_columns"),
        F.round(F.avg("psi"), 6).alias("avg_psi"),
        F.round(F.avg("ks_statistic"), 6).alias("avg_ks_stat"),
    ).filter(F.col("total_columns") > 0)
    part = F.col("drifted_columns") / F.col("total_columns")
    return totals.withColumn("drift_pct", F.round(part * 100, 2)).select(
        "drifted_columns",
        "total_columns",
        "drift_pct",
        "avg_psi",
        "avg_ks_stat",
        F.round(part, 4).alias("drift_score"),
        (F.col("drift_pct") > 0).alias("drift_detected"),
        drift_severity(F.col("drift_pct")).alias("drift_severity"),
    )


def enough_rows(summary: DataFrame, sides: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """Adds the rows per side; nothing is returned when a side has too few."""
    counted = side_rows(sides).select(F.struct("current_rows", "reference_rows").alias("rows"))
    return (
        summary.withColumn("rows", counted.scalar())
        .select("*", "rows.current_rows", "rows.reference_rows")
        .drop("rows")
        .filter((F.col("current_rows") >= config.min_rows) & (F.col("reference_rows") >= config.min_rows))
    )
