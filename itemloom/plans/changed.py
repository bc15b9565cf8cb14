"""Item rows for what has changed only: features are kept by a digest of their text, and computed once for each.

The store is a table of digests and features in a folder. A run joins its items' digests with it; texts that it lacks are
computed, each different one once, and appended. The digest covers the text, the mode and VERSION, so that a change of the
features themselves makes all of them new.

Defined results: equal to plans.item.text_features, column by column; null texts have a digest of their own; items of equal texts
share a row of the store; two runs at the same time may both append a text, which is read once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import hadoop_path, written
from .item import text_features

#: To be raised whenever a feature is computed differently.
VERSION = 1


def text_digest(text: Column, mode: str) -> Column:
    """What a row of features is known by."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(VERSION)), F.lit(mode), F.coalesce(F.sha2(text, 256), F.lit("null"))), 256)


def missing(items: DataFrame, folder: str, text: str = "text", mode: str = "estimate") -> DataFrame:
    """__digest, __text: the different texts whose features the store lacks."""
    spark = items.sparkSession
    named = items.select(text_digest(F.col(text), mode).alias("__digest"), F.col(text).alias("__text"))
    at, files = hadoop_path(spark, folder)
    if files.exists(at):
        named = named.join(spark.read.parquet(folder).select("__digest"), "__digest", "left_anti")
    return named.groupBy("__digest").agg(F.first("__text").alias("__text"))


def text_features_kept(items: DataFrame, folder: str, text: str = "text", mode: str = "estimate") -> DataFrame:
    """The kept columns (all but the text) and 34 feature columns; folder: where features are kept between runs."""
    spark = items.sparkSession
    text_features(missing(items, folder, text, mode), "__text", mode=mode).write.mode("append").parquet(folder)
    named = items.withColumn("__digest", text_digest(F.col(text), mode))
    # a table of this run's own: in one query Spark takes two reads of the growing folder for the same
    own = written(spark.read.parquet(folder).join(named.select("__digest"), "__digest", "left_semi").dropDuplicates(["__digest"]))
    features = [c for c in own.columns if c != "__digest"]
    names = {f.lower() for f in features}
    keep = [c for c in items.columns if c != text and c.lower() not in names]
    return named.select(*keep, "__digest").join(own, "__digest").select(*keep, *features)
