"""Order-dependent operators that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegraph.session import shared_folder


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key. A minimum over (order, row) combines map-side, so a hot key
    costs one row per task in the shuffle; a window would move and sort the whole group."""
    rest = [c for c in df.columns if c not in keys]
    tail = [c for c in rest if c not in order]
    lead = [c for c in order if c in rest]
    packed = F.struct(*[F.col(c) for c in lead + tail])
    return (
        df.groupBy(*keys).agg(F.min(packed).alias("__first"))
        .select(*keys, *[F.col(f"__first.{c}").alias(c) for c in lead + tail])
        .select(*df.columns)
    )


def match_array(text: Column, pattern: str, group: int = 0, limit: int | None = None) -> Column:
    """Matches in document order, at most `limit`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.slice(found, 1, limit) if limit else found




def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank 1..n inside each group, also when one group owns a large share of the rows.

    Rows are range-partitioned by (group, order), so a big group spans many partitions in order. A row's rank is its
    number inside its own partition piece plus the sizes of the group's earlier pieces. The ranged rows are
    checkpointed: pieces and piece sizes must come from one and the same partitioning. `order` must be total."""
    shared_folder(df.sparkSession)
    ranged = (
        df.repartitionByRange(*[F.col(g) for g in group], *order)
        .withColumn("__piece", F.spark_partition_id()).checkpoint()
    )
    earlier = W.partitionBy(*group).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = (
        ranged.groupBy(*group, "__piece").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .select(*group, "__piece", "__before")
    )
    inside = F.row_number().over(W.partitionBy(*group, "__piece").orderBy(*order))
    return (
        ranged.withColumn("__inside", inside).join(pieces, [*group, "__piece"])
        .withColumn(name, (F.col("__before") + F.col("__inside")).cast("int"))
        .select(*df.columns, name)
    )
