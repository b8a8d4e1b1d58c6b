"""Exact top-k by inner product with a pivot table.

For vectors of whole numbers ``q.c = (|q|^2 + |c|^2 - d(q,c)^2) / 2``. Distances to many
pivots bound ``d(q,c)`` from below by the largest ``|d(q,p) - d(c,p)|``, which bounds the
product from above. Candidates are evaluated in the order of that bound until none
that is left can enter the best k.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import map_batches

#: Pivots, and the rows they are chosen from; neither grows with the table.
PIVOTS, PIVOT_ROWS = 32, 2000
#: Rows in a block of candidates, and in a block of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Candidates evaluated between two looks at the bound.
STEP = 64
SCALE = 256


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components ``floor(scale * x)``. Vectors that are null, or hold a
    null or a non-finite component, take no part."""
    x = F.col("embedding")
    v = vectors.where(x.isNotNull()).select("vec_id", F.transform(x, lambda e: e.cast("double")).alias("x"))
    v = v.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    return v.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def choose_pivots(v: DataFrame, n: int, count: int = PIVOTS, rows: int = PIVOT_ROWS) -> np.ndarray:
    """Far-apart rows of a bounded sample of the ``n`` rows: each next pivot is the row farthest from those chosen."""
    h = F.xxhash64("vec_id")
    # few rows more than are needed are ordered, whatever the table holds
    drawn = v if n <= 4 * rows else v.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 4 * rows / n))
    some = [r.v for r in drawn.orderBy(h, "vec_id").limit(rows).select("v").collect()]
    x = np.array(some, dtype=np.float64)
    if not x.shape[1]:
        return x[:1]
    x = np.unique(x, axis=0)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def table(v: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id, v`` plus ``near`` (nearest pivot) and ``to_pivots``, its row of the pivot table."""

    def run(batch):
        if not batch.num_rows:
            return
        raw = batch.column("v")
        x = np.stack(raw.to_numpy(zero_copy_only=False)).astype(np.int64)
        d = np.sqrt(np.maximum(0, (x.astype(float) ** 2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T))
        yield {"vec_id": batch.column("vec_id"), "v": raw, "near": d.argmin(1), "to_pivots": list(d)}

    return map_batches(v.select(F.col("vec_id").cast("bigint"), "v"), run, "vec_id BIGINT, v ARRAY<BIGINT>, near INT, to_pivots ARRAY<DOUBLE>")


def in_blocks(t: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows of like places together, so many to a block: ``ids, m, d`` in one row per block.

    Ranges over (nearest pivot, distance, id) spread a pivot of any size."""
    dealt = t.repartitionByRange(parts, "near", F.get("to_pivots", F.col("near")), "vec_id")

    def run(batches):
        from itertools import chain

        rest: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None:
                rest.append(b)
            held = sum(x.num_rows for x in rest)
            while held >= size or (b is None and held):
                whole = pa.Table.from_batches(rest).combine_chunks()
                part = whole.slice(0, size)
                rest = whole.slice(size).to_batches()
                held = sum(x.num_rows for x in rest)
                m = np.stack(part.column("v").to_numpy()).astype("<i8")
                d = np.stack(part.column("to_pivots").to_numpy()).astype("<f8")
                ids = part.column("vec_id").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (ids, m, d)], names=["ids", "m", "d"])

    return dealt.drop("near").mapInArrow(run, "ids BINARY, m BINARY, d BINARY")


def best_of(q: tuple, c: tuple, k: int):
    """Best k of one block of candidates for each query of a block: query ids, ids, scores."""
    (q_ids, q_m, q_d), (c_ids, c_m, c_d) = q, c
    q_norm, c_norm = (q_m.astype("f8") ** 2).sum(1), (c_m.astype("f8") ** 2).sum(1)
    # no sum on the way passes |q||c|: below 2^53 doubles are exact, and fast
    if len(q_ids) and len(c_ids) and q_norm.max() * c_norm.max() < 2.0**104:
        q_m, c_m = q_m.astype("f8"), c_m.astype("f8")
    out = []
    for i in range(len(q_ids)):
        low = np.abs(c_d - q_d[i]).max(1)
        # distances are rounded; a hair is given away so that the bound stays one
        low = np.maximum(0, low - 1e-6 * (1 + low))
        bound = (q_norm[i] + c_norm - low * low) / 2 * (1 + 1e-12) + 1e-3
        order = np.argsort(-bound, kind="stable")
        score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while at < len(order):
            if len(score) == k and bound[order[at]] < score[-1]:
                break
            some = order[at : at + step]
            some = some[c_ids[some] != q_ids[i]]
            score, ids = np.r_[score, (c_m[some] @ q_m[i]).astype(np.int64)], np.r_[ids, c_ids[some]]
            best = np.lexsort((ids, -score))[:k]
            score, ids = score[best], ids[best]
            at, step = at + step, 2 * step
        out += [(int(q_ids[i]), int(v), int(s)) for s, v in zip(score, ids, strict=True)]
    return out


def _search(v: DataFrame, width: int, n: int, asked: int, is_query, k: int, pivots: int) -> DataFrame:
    """The best k within one block of candidates, for all vectors of one length."""
    t = materialise(table(v, choose_pivots(v, n, pivots)), "pivot-table")
    q = in_blocks(t.where(is_query), QUERY_BLOCK, -(-asked // QUERY_BLOCK))
    q = materialise(q.select(F.monotonically_increasing_id().alias("q"), *[F.col(x).alias(f"q_{x}") for x in ("ids", "m", "d")]), "query-blocks")
    c = materialise(in_blocks(t, BLOCK, -(-n // BLOCK)).withColumn("c", F.monotonically_increasing_id()), "candidate-blocks")
    # the stated queries against all rows, in blocks: a pair of numbers for every two blocks
    pairs = c.select("c").crossJoin(q.select("q"))
    met = pairs.join(q, "q").join(c, "c").repartition(max(1, c.count() * q.count()), "c", "q")

    def run(batch):
        for r in batch.to_pylist():
            def part(x, r=r):
                ids = np.frombuffer(r[x + "ids"], "<i8")
                return ids, np.frombuffer(r[x + "m"], "<i8").reshape(len(ids), width), np.frombuffer(r[x + "d"], "<f8").reshape(len(ids), -1)

            found = best_of(part("q_"), part(""), k)
            yield {n: [f[i] for f in found] for i, n in enumerate(("query_id", "vec_id", "score"))}

    return map_batches(met, run, "query_id BIGINT, vec_id BIGINT, score BIGINT")


def search(vectors: DataFrame, is_query=None, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best among all other rows, ties to the smaller id.

    * Rows whose id is null take no part. A row that repeats another counts once;
      other columns are not read.
    * Vectors of different lengths have no product: each length is searched by itself, a
      length of 0 with products of 0. Very long vectors are read whole.
    * Fewer than k other rows: all of them. No rows: none.
    * Equal vectors under different ids are different candidates.
    """
    spark = vectors.sparkSession
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    schema = "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT"
    v = whole_numbers(vectors.where(F.col("vec_id").isNotNull())).dropDuplicates(["vec_id", "v"])
    v = materialise(v.withColumn("width", F.size("v")), "vectors")
    lengths = v.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked")).where("asked > 0")
    found = [_search(v.where(F.col("width") == r.width).drop("width"), r.width, r.n, r.asked, is_query, k, pivots) for r in lengths.toLocalIterator()]
    if not found:
        return spark.createDataFrame([], schema)
    few = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def op10_topk(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
