"""Top-k and most-common helpers with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    """Ordered rows, the first ``k`` of them when ``k`` is given."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def top_lists(df: DataFrame, k: int, lists: dict[str, tuple[Column | None, tuple[Column, ...]]], ties: tuple[str, ...]) -> DataFrame:
    """Several top lists of one table in one pass: its columns and ``ranking``.

    ``lists`` maps a list's name to a filter (or ``None``) and its numeric sort
    keys, smallest first, nulls last; ``ties`` are text columns that end every
    order. Rows are dealt to the lists they can stand in and ranked there.
    """
    from pyspark.sql import Window

    offers = [
        F.when(F.lit(True) if kept is None else kept, F.struct(F.lit(name).alias("ranking"), F.array(*(F.coalesce(x.cast("double"), F.lit(float("inf"))) for x in keys)).alias("keys")))
        for name, (kept, keys) in lists.items()
    ]
    dealt = df.withColumn("_offer", F.explode(F.array_compact(F.array(*offers))))
    order = Window.partitionBy("_offer.ranking").orderBy("_offer.keys", *ties)
    ranked = dealt.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return ranked.withColumn("ranking", F.col("_offer.ranking")).drop("_offer", "_rank")


def most_common(df: DataFrame, keys: list[str], value: str, weight: Column, out: str) -> DataFrame:
    """Per key the value with the greatest weight, by name on ties, and that weight."""
    counted = df.groupBy(*keys, value).agg(weight.alias("_n"))
    best = F.min_by(F.struct(value, "_n"), F.struct(-F.col("_n"), F.col(value)))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col(f"_best.{value}").alias(out), F.col("_best._n").alias(f"{out}_count")
    )


def common_values(rows: DataFrame, columns: dict[str, str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of several columns, one pass over the rows.

    ``columns`` maps label to column name. Null values are skipped. Ties go by
    name. Counting happens per (label, value), so only distinct values are ranked.
    """
    from pyspark.sql import Window

    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(col).cast("string").alias("name")) for label, col in columns.items()])
    counted = (
        rows.select(F.explode(pairs).alias("p"))
        .select("p.label", "p.name")
        .where(F.col("name").isNotNull())
        .groupBy("label", "name")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy("label").orderBy(F.desc("count"), F.asc("name"))
    return counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")
