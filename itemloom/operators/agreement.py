"""Cohen's kappa between two raters, over a table, by groups, and over what arrives day by day.

The state of kappa is a contingency table: how often each pair of labels was given. It has as many rows as there are pairs of
labels, and such tables add up, so kappa of any number of days, parts or streams comes from theirs without reading ratings again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def contingency(ratings: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """by, a, b, c: how often each pair of labels was given. Pairs with a null rating are left out."""
    rated = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rated.select(*(by or []), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).groupBy(*(by or []), "a", "b").agg(F.count(F.lit(1)).alias("c"))


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Contingency tables of several parts, as one."""
    return parts.groupBy(*(by or []), "a", "b").agg(F.sum("c").alias("c"))


def kappa_of_counts(counts: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """agreement, kappa and n (of each group) from a contingency table; no pairs give zeros."""
    one = [F.lit(0).alias("__g")] if not by else [F.col(c) for c in by]
    by = by or []
    keys = by or ["__g"]
    pairs = counts.select(*one, "a", "b", "c")
    sides = pairs.select(*keys, F.col("c"), F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb")))).alias("s"))
    margins = sides.groupBy(*keys, "s.label").agg(F.sum("s.ca").alias("ca"), F.sum("s.cb").alias("cb"))
    chance = margins.groupBy(*keys).agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("both"))
    same = pairs.groupBy(*keys).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"), F.sum("c").alias("n"))
    n = F.col("n").cast("double")
    joined = same.join(chance, keys).withColumns({"__a": F.col("same") / n, "__e": F.col("both") / (n * n)})
    out = joined.select(*by, F.round("__a", digits).alias("agreement"), F.when(F.col("__e") >= 1, 0.0).otherwise(F.round((F.col("__a") - F.col("__e")) / (1 - F.col("__e")), digits)).alias("kappa"), "n")
    if by:
        return out
    return out.agg(F.coalesce(F.max("agreement"), F.lit(0.0)).alias("agreement"), F.coalesce(F.max("kappa"), F.lit(0.0)).alias("kappa"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def kappa(ratings: DataFrame, a: str, b: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """agreement, kappa and n (of each group). Pairs with a null rating are left out; no pairs give zeros.

    Pairs are counted first (combined before the shuffle), so all later steps see as many rows as there are label pairs.
    """
    return kappa_of_counts(contingency(ratings, a, b, by), by, digits)


# ---------------------------------------------------------------- over days


def keep_counts(ratings: DataFrame, a: str, b: str, folder: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """A stream's contingency tables, one for each of its batches, under folder; takes what there is and ends.

    A batch that is run again after a failure replaces its own table, so every rating counts once.
    """

    def put(batch: DataFrame, number: int) -> None:
        contingency(batch, a, b, by).coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return ratings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_counts(spark: SparkSession, folder: str, by: list[str] | None = None) -> DataFrame:
    """The contingency table of all batches so far."""
    return merged(spark.read.option("basePath", folder).parquet(f"{folder.rstrip('/')}/batch=*"), by)


def kappa_of(coder1: list, coder2: list, spark) -> dict:
    """The same for two lists of ratings; they must be as long as each other."""
    if len(coder1) != len(coder2):
        raise ValueError("the raters' lists differ in length")
    rows = spark.createDataFrame([(str(x), str(y)) for x, y in zip(coder1, coder2, strict=True)], "a string, b string")
    return kappa(rows, "a", "b").first().asDict()
