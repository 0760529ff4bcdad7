"""Mixing of documents to target weights over a tree such as domain, language, source.

Weights are shared out from the top: a node's token budget goes to its children by weight.
A child can give at most ``max_epochs`` times the tokens below it; what it lacks goes to its
siblings by weight, and only what all of them cannot give is left to the siblings of their
parent, and so on up.  As a node's capacity is the sum of its leaves', this is one pass from
the root to the leaves, in closed form: children are ordered by capacity per weight, those
that cannot fill their share come first.

A leaf repeats its documents in whole epochs and takes the rest as a prefix of one more epoch,
in an order hashed from seed, epoch and id, up to and including the document that reaches the
budget.  Prefix sums are taken over hash buckets first, so a leaf of any size is spread out
and only the bucket at the end of the prefix is sorted.

Rows: NULL labels count as the empty label, NULL tokens as none; documents without tokens are
taken with the rest of their epoch as long as the budget is not yet reached.  Rows that repeat
an id are ordered by a hash of the whole row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepulse.llm.storage import landed

BUCKET_DIGITS = 3  # hex digits of the hash: 4,096 buckets in a leaf


def _weight(label: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(label == name, F.lit(float(weight))).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: Sequence[str], label: str, weights: Mapping[str, float]) -> DataFrame:
    """``budget`` of each child, given ``parent_budget`` and ``capacity`` (doubles) on its row.

    Labels without an entry in ``weights`` weigh 1; a weight of zero or less gives nothing.
    """
    rows = nodes.withColumn("__w", _weight(F.col(label), weights)).withColumn("__w", F.greatest("__w", F.lit(0.0)))
    rows = rows.withColumn("__ratio", F.when(F.col("__w") > 0, F.col("capacity") / F.col("__w")).otherwise(F.lit(float("inf"))))
    own = Window.partitionBy(*parent)
    before = own.orderBy("__ratio", label).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__left", F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
    rows = rows.withColumn("__weights", F.sum("__w").over(own) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    rows = rows.withColumn("__level", F.when(F.col("__weights") > 0, F.col("__left") / F.col("__weights")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("__short", F.col("capacity") <= F.col("__level") * F.col("__w"))
    # The level of the first child that is not short holds for all that are not.
    first = F.min(F.when(~F.col("__short"), F.struct("__ratio", label, "__level"))).over(own)
    rows = rows.withColumn("__fill", first["__level"])
    return rows.withColumn(
        "budget", F.when(F.col("__short"), F.col("capacity")).otherwise(F.floor(F.col("__fill") * F.col("__w")).cast("double"))
    ).drop("__w", "__ratio", "__left", "__weights", "__level", "__short", "__fill")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], share: float, max_epochs: int
) -> DataFrame:
    """``levels``, ``tokens`` and ``budget`` of each leaf; the root's budget is ``share`` of all tokens.

    ``leaves`` has one row per leaf, with its ``tokens``.
    """
    tree = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * share).cast("double").alias("budget"))
    upper, known = total, []
    for depth, level in enumerate(levels):
        nodes = tree.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        above = upper.select(*known, F.col("budget").alias("parent_budget"))
        # The root is one row.
        nodes = nodes.join(above, known) if known else nodes.join(F.broadcast(above), F.lit(True))
        upper, known = share_out(nodes, known, level, weights[depth]), list(levels[: depth + 1])
    return upper.select(*levels, "budget").join(leaves, list(levels))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, float]], tokens: Column,
    share: float = 1.0, max_epochs: int = 2, seed: int = 0, id_col: str = "doc_id",
) -> DataFrame:
    """The selected rows of ``docs`` with ``mix_epoch`` (from 0), ``mix_tokens`` and ``mix_budget`` of the leaf.

    ``levels`` names the labels from the root's children to the leaves.  Everything is decided
    on a table without the texts; the texts are then read once and never shuffled, as long as
    the table of leaves is small enough for Spark to send it to the tasks.
    """
    names = [f"__{n}" for n in levels]
    base = docs.drop("mix_epoch", "mix_tokens", "mix_budget")
    mark = F.xxhash64(*[c for c, kind in base.dtypes if not kind.startswith(("map", "variant"))])
    labelled = base.select(
        "*",
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())],
        F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint")).alias("mix_tokens"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
        mark.alias("__mark"),
    )
    narrow = landed(labelled.select(*names, "mix_tokens", "__id", "__mark"), "mix_tokens")
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"))
    whole = F.floor(F.col("budget") / F.col("tokens"))
    plan = leaf_budgets(leaves, names, weights, share, max_epochs).where("budget > 0").select(
        *names,
        F.col("budget").cast("bigint").alias("mix_budget"),
        whole.cast("int").alias("__full"),
        (F.col("budget") - whole * F.col("tokens")).cast("bigint").alias("__rest"),
    )
    plan = landed(plan, "mix_plan")

    def ordered(rows: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__full").cast("string"), "__id"))
        return rows.withColumn("__place", F.struct(order.alias("order"), "__id", "__mark"))

    rows = ordered(narrow.join(plan.where("__rest > 0"), names))
    rows = rows.withColumn("__bucket", F.substring("__place.order", 1, BUCKET_DIGITS))
    sums = rows.groupBy(*names, "__bucket").agg(F.sum("mix_tokens").alias("n"), F.first("__rest").alias("rest"))
    earlier = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("ahead < rest")
    # One row per leaf: the bucket in which its prefix ends, and the tokens before it.
    ends = sums.groupBy(*names).agg(F.max(F.struct("__bucket", "ahead")).alias("end"))
    ends = ends.select(*names, F.col("end.__bucket").alias("__bucket"), F.col("end.ahead").alias("__ahead"))
    last = rows.join(ends, [*names, "__bucket"])
    within = Window.partitionBy(*names).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("__before", F.col("__ahead") + F.coalesce(F.sum("mix_tokens").over(within), F.lit(0)))
    last = last.where("__before < __rest").groupBy(*names).agg(F.max("__place").alias("__end"))
    plan = landed(plan.join(last, names, "left"), "mix_ends")

    chosen = ordered(labelled.join(plan, names))
    epochs = F.col("__full") + F.coalesce(F.col("__place") <= F.col("__end"), F.lit(False)).cast("int")
    kept = [c for c in labelled.columns if not c.startswith("__")]
    chosen = chosen.withColumn("__epochs", epochs).where("__epochs > 0")
    return chosen.select(*kept, "mix_budget", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)).alias("mix_epoch"))
