"""Mix sources to target weights by systematic sampling.

Built-in expressions only. A source of any size is spread over many buckets; the
place of a document in its source is the bucket's start plus its place in the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import words

#: Fixed values of the mix: weights by the order of sources, what the mix holds, what a source may give.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Buckets of a source within one class of sizes.
BUCKETS = 127


def targets(sized: DataFrame, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    The mix holds ``share`` of all sizes. Sources whose share by weight would be
    above ``limit`` times their size stop there; what they leave goes to the others
    by weight. Ordered by size over weight, the sources that stop come first, so one
    running sum finds them all.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a few rows, one per source
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(in_order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("stop", F.col("source_size") * limit)
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("all_size") * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("place", F.row_number().over(rising)).withColumn("level", level)
    # the first source that does not stop: its level holds for all that follow
    first = F.min(F.when(F.col("stop") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("first", first)
    stops = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return s.select("source", "source_size", F.when(stops, F.col("stop")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def copies(sized: DataFrame, goal: DataFrame, seed: int = 7) -> DataFrame:
    """``sized`` (``doc_id, source, size``) with its source's figures and ``copies``.

    Expected copies of a document are target over source size. Their running sum
    within the source, plus one random offset per source, crosses a whole number
    once per copy. Documents are ordered by classes of size, so that each class is
    hit in proportion and the words taken come near the target.
    """
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(key.alias("_key"), "source_size", "target", rate.alias("_rate"))
    d = sized.select(
        "*",
        key.alias("_key"),
        F.floor(F.log2(F.col("size") + 1) * 16).alias("_class"),
        F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS)).alias("_bucket"),
    )
    group = ["_key", "_class", "_bucket"]
    in_source = Window.partitionBy("_key").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(in_source), F.lit(0))).drop("_n")
    d = d.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy("size", "doc_id", *[F.xxhash64(c) for c in d.columns if c == "text"])))
    d = d.join(starts, group).join(goal, "_key")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key.s"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    at = lambda k: F.floor(offset + F.col("_rate") * k)
    place = F.col("_start") + F.col("_place")
    return d.withColumn("copies", at(place) - at(place - 1)).drop("_key", "_class", "_bucket", "_start", "_place", "_rate")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row.

    * A null or blank text has size 0: it is sampled like any other row and adds nothing.
    * A null source is a source of its own, last in order.
    * A null ``doc_id`` is an ordinary row; repeated rows are sampled one by one.
    * A source without words has target 0 and gives no copies.
    * Other columns are not read.
    """
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"))
    sized = materialise(sized, "mix-sizes")
    goal = materialise(targets(sized), "mix-targets")
    return copies(sized, goal, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: ``docs``, each row as often as it is taken."""
    n = F.size(words(F.col("text"))).cast("bigint").alias("size")
    goal = materialise(targets(materialise(docs.select("source", n), "mix-sizes")), "mix-targets")
    # figures of the mix must not clash with columns of the documents
    kept = docs.select("doc_id", "source", "text", n, F.struct(*docs.columns).alias("_row"))
    taken = copies(kept, goal, seed).where("copies > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, source_size * 2.0::DOUBLE AS stop FROM src),
l AS (
  SELECT *, row_number() OVER (ORDER BY stop / weight, source ASC NULLS LAST) AS place,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(stop) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN stop > level * weight THEN place END) OVER () AS first FROM l),
goal AS (
  SELECT source, source_size, CASE WHEN first IS NULL OR place < first THEN stop ELSE max(CASE WHEN place = first THEN level END) OVER () * weight END AS target
  FROM f),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(d.size + 1) * 16), coalesce(d.doc_id, 0) % 127, d.size, d.doc_id) AS place
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor(u + rate * place) - floor(u + rate * (place - 1)) AS BIGINT) * size AS taken FROM placed"""


def op7_mixing(spark, sf_dir):
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", "taken")
