"""Exact top-k inner products by norm-bucketed retrieval.

1. ``buckets``: candidates are range-partitioned by length, longest first, and packed: one row per bucket with its ids,
   vectors and lengths. Ties of length split by id, so a vector that a third of all rows repeat is spread over buckets.
2. ``first``: every query meets the bucket of the longest vectors. Its k-th score there is the query's threshold.
3. ``rest``: the other buckets come in rounds of doubling size, each with the k-th score of all before it, so a query gets
   about k rows a round however many buckets there are. It goes only to buckets whose longest vector can reach the
   threshold (its length times the query's).
   In a bucket the threshold over both lengths is the local cosine threshold c. Low c: length pruning - candidates shorter
   than threshold / |q| are out. High c: coordinate pruning - on the query's heaviest coordinates a candidate's
   normalized value must lie in q_i c -+ sqrt((1 - c^2)(1 - q_i^2)). What is left is verified with exact products.

Queries and buckets meet block by block (bucket, query block), both bounded in rows. Pruning uses a tolerance and drops
only what is strictly below the threshold; of candidates at the threshold only smaller ids than the k-th so far come back,
so a vector that many rows repeat returns k rows for a query, not k from every bucket.

Components become floor(scale * x), of any size. Products are summed in double where that is exact (|q| |c| < 2^53), else
in 64-bit integers (|q| |c| < 2^62), else in integers without a bound; a score beyond 64 bits is given as the nearest
64-bit number, and such scores rank as equal.

Cases: vectors that are null or empty or hold null or non-finite components take no part, nor do rows with a null id; of several rows under one id the largest vector counts; vectors of different
dimension never meet; fewer than k candidates give all; a query's own id is not its candidate; empty tables give an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.common import cut

BUCKET_ROWS, QUERY_ROWS = 8192, 2048
COORDINATE_FROM = 0.75  # local cosine threshold from which coordinate pruning is used
FOCUS = 4               # coordinates looked at


def integral(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double> of whole numbers, dim, norm) of the vectors that take part."""
    largest = float(np.finfo(np.float64).max)

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-largest)), F.lit(largest))
        return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)   # larger doubles are whole

    scaled = F.transform(F.col(vec_col), whole)
    fits = F.forall(F.col(vec_col), lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(largest), F.lit(False)))
    kept = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
        .filter(F.col("vec_id").isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & fits)
        .groupBy("vec_id").agg(F.max(scaled).alias("v"))
    )
    return (
        kept.withColumn("dim", F.size("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    )


def buckets(vectors: DataFrame, count: int) -> DataFrame:
    """(bucket, dim, longest, ids, norms, wide, matrix): packed candidates, longest first; 32-bit numbers unless `wide`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                norms = rows.column("norm").to_numpy()
                values = rows.column("v").flatten().to_numpy()
                wide = bool((np.abs(values) >= 2.0 ** 31).any())
                made += 1
                yield pa.RecordBatch.from_pylist([{
                    "bucket": (part << 32) + made, "dim": int(dim), "longest": float(norms.max()),
                    "ids": rows.column("vec_id").to_numpy().tobytes(), "norms": norms.tobytes(),
                    "wide": wide, "matrix": values.astype(np.float64 if wide else np.int32).tobytes(),
                }], schema=pa.schema([("bucket", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("norms", pa.binary()), ("wide", pa.bool_()), ("matrix", pa.binary())]))

    parts = max(1, -(-count // BUCKET_ROWS))
    return vectors.repartitionByRange(parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id")).sortWithinPartitions(
        "dim", F.col("norm").desc(), "vec_id").mapInArrow(run, "bucket long, dim int, longest double, ids binary, norms binary, wide boolean, matrix binary")


def _products(q: np.ndarray, c: np.ndarray, q_norm: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers. No partial sum is larger than the product of the lengths."""
    bound = float(q_norm.max()) * float(c_norm.max()) if len(c_norm) and len(q_norm) else 0.0
    if bound < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    limit = np.iinfo(np.int64)
    return np.clip(whole(q) @ whole(c).T, limit.min, limit.max).astype(np.int64)


def survivors(q: np.ndarray, q_norm: float, c: np.ndarray, norms: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of a bucket (longest first) that may reach the threshold of one query."""
    if q_norm == 0 or threshold <= 0:
        return np.arange(len(norms)) if threshold <= 0 else np.zeros(0, np.int64)
    reach = int(np.searchsorted(-norms, -(threshold / q_norm) * (1 - 1e-9), side="right"))
    cosine = threshold / (q_norm * norms[0]) if reach else 0.0
    if cosine < COORDINATE_FROM or not reach:
        return np.arange(reach)
    cosine, unit = min(1.0, cosine), q / q_norm
    alive = np.arange(reach)
    for k in np.argsort(-np.abs(unit))[:FOCUS]:
        slack = np.sqrt(max(0.0, (1 - cosine ** 2) * (1 - unit[k] ** 2))) + 1e-9
        value = c[alive, k] / np.maximum(norms[alive], 1e-300)
        # a candidate with a higher cosine lies in a narrower interval around a higher centre: test the union over [c, 1]
        low, high = unit[k] * cosine - slack, unit[k] * cosine + slack
        if cosine <= abs(unit[k]):
            low, high = (low, 1.0) if unit[k] > 0 else (-1.0, high)
        alive = alive[(value >= low - 1e-9) & (value <= high + 1e-9)]
    return alive


def scored(packed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each bucket for each query routed to it.
    `queries`: bucket, block, vec_id, v, norm, threshold and limit_id (null: none yet): the k-th best so far; a candidate
    must come before it."""

    def run(key, held: pa.Table, asked: pa.Table) -> pa.Table:
        out = [[], [], []]
        if held.num_rows and asked.num_rows:
            row = held.to_pylist()[0]
            ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float64)
            c = np.frombuffer(row["matrix"], np.float64 if row["wide"] else np.int32).reshape(len(ids), row["dim"])
            q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, row["dim"])
            q_ids, q_norms = asked.column("vec_id").to_numpy(), asked.column("norm").to_numpy()
            # compared with exact scores: 64-bit numbers, the least one for no threshold yet
            exact = np.array([np.iinfo(np.int64).min if t is None else t for t in asked.column("threshold").to_pylist()], np.int64)
            before = np.array([np.iinfo(np.int64).max if t is None else t for t in asked.column("limit_id").to_pylist()], np.int64)
            limits = np.array([-np.inf if t is None else float(t) for t in asked.column("threshold").to_pylist()])
            with np.errstate(divide="ignore", invalid="ignore"):
                local = np.where(q_norms > 0, limits / (q_norms * max(norms[0], 1e-300)), 0.0)
            by_length = np.flatnonzero(~(local >= COORDINATE_FROM))
            plans = [(by_length[a: a + 64], None) for a in range(0, len(by_length), 64)]
            plans += [(np.array([n]), survivors(q[n].astype(np.float64), q_norms[n], c, norms, limits[n])) for n in np.flatnonzero(local >= COORDINATE_FROM)]
            for rows, alive in plans:
                if alive is None:  # a block of queries shares the longest prefix that length pruning leaves one of them
                    reach = max(len(survivors(q[n].astype(np.float64), q_norms[n], c, norms, limits[n])) for n in rows)
                    alive = np.arange(reach)
                if not len(alive):
                    continue
                score = _products(q[rows], c[alive], q_norms[rows], norms[alive])
                for n, own in zip(rows, score):
                    fit = np.flatnonzero(((own > exact[n]) | ((own == exact[n]) & (ids[alive] < before[n]))) & (ids[alive] != q_ids[n]))
                    if len(fit) > k:
                        least = np.partition(own[fit], len(fit) - k)[len(fit) - k]
                        fit = fit[own[fit] >= least]
                        fit = fit[np.lexsort((ids[alive[fit]], ~own[fit]))[:k]]   # ~ turns the order of all 64-bit numbers
                    out[0].append(np.full(len(fit), q_ids[n]))
                    out[1].append(ids[alive[fit]])
                    out[2].append(own[fit])
        made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.table({"query_id": made[0], "vec_id": made[1], "score": made[2]})

    return packed.groupBy("bucket", "block").cogroup(queries.groupBy("bucket", "block")).applyInArrow(run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where `is_query`, a function of the id column, holds."""
    every = cut(integral(vectors, id_col, vec_col, scale))
    counts = every.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).first()
    packed = cut(buckets(every, counts.n))
    # one row per bucket of thousands of vectors, as (bucket, dim, longest): what queries are routed by
    spread = 1 << max(0, -(-counts.n // BUCKET_ROWS) - 1).bit_length()
    turn = F.floor(F.log2(F.pmod(F.xxhash64("bucket"), F.lit(spread)) + 1)).cast("int")
    heads = cut(packed.select(*[F.col(c).alias(c) for c in ("bucket", "dim", "longest")], turn.alias("round")))  # columns of its own
    longest = heads.groupBy("dim").agg(F.max(F.struct("longest", "bucket")).alias("top")).select("dim", F.col("top.bucket").alias("top_bucket"))
    blocks = max(1, -(-counts.q // QUERY_ROWS))
    asked = every.filter(is_query(F.col("vec_id"))).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    found = cut(scored(
        packed.join(longest.select(F.col("top_bucket").alias("bucket")), "bucket", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
        asked.join(longest, "dim").select(F.col("top_bucket").alias("bucket"), "block", "vec_id", "v", "norm", F.lit(None).cast("long").alias("threshold"), F.lit(None).cast("long").alias("limit_id")), k))
    worst = F.max(F.struct(F.bitwise_not("score").alias("turned"), "vec_id"))   # ~ turns the order of all 64-bit numbers
    able = F.col("threshold").isNull() | (F.col("threshold") <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("threshold"))
    rest = heads.join(longest, "dim").filter(F.col("bucket") != F.col("top_bucket"))
    for number in sorted(r[0] for r in rest.select("round").distinct().collect()):  # at most 64
        limits = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), worst.alias("worst")).filter(F.col("n") >= k).select(
            F.col("query_id").alias("vec_id"), F.bitwise_not("worst.turned").alias("threshold"), F.col("worst.vec_id").alias("limit_id"))
        route = (
            asked.join(limits, "vec_id", "left").join(rest.filter(F.col("round") == number), "dim").filter(able)
            .select("bucket", "block", "vec_id", "v", "norm", "threshold", "limit_id")
        )
        # a bucket is copied for the query blocks that come to it, not for all
        wanted = cut(route.select("bucket", "block").distinct())
        found = cut(best_of(found.unionByName(scored(packed.join(wanted, "bucket"), route, k)), k).drop("rank"))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
