"""Item features over streams. Text features are projections without state, so a stream needs nothing more than a batch does;
the roll-up of images to items keeps state, bounded by a watermark, and so does the join of items with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.visual import FLAT_FEATURES, MAXIMA, MEANS, SUMS
from ..plans.item import text_features


def read_items(spark: SparkSession, path: str, schema: str = "item_id long, text string", files_each: int | None = None) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader if files_each is None else reader.option("maxFilesPerTrigger", files_each)).parquet(path)


def item_stream(items: DataFrame, text: str = "text") -> DataFrame:
    return text_features(items, text)


def image_rollup_stream(images: DataFrame, item: str = "item_id", time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Visual features by item and window of time; rows later than the watermark are left out and state behind it goes."""
    kinds = {n: F.sum for n in SUMS} | {n: F.max for n in MAXIMA} | {n: F.avg for n in MEANS}
    return images.withWatermark(time, late).groupBy(F.window(time, window), item).agg(*[kinds[n](n).alias(n) for n in FLAT_FEATURES])


def item_features_stream(items: DataFrame, images: DataFrame, item: str = "item_id", text: str = "text", time: str = "ts", late: str = "10 minutes", window: str = "1 hour", mode: str = "estimate") -> DataFrame:
    """The full row of each item of a stream: 34 text features, and the 11 visual ones of its images of the same window.

    items: item, text, time; images: item, time and the 11 flat features of each image. An item whose images have not come when
    the watermark (the least of both streams' latest times, less `late`) passes its window's end goes out with null visual
    features. Rows that come later than that are left out. State is bounded by the windows that are open. The watermark moves on
    once a run has seen rows of both streams.

    Defined results: several rows of one item in a window each get the window's images; null times are late; null items have no
    images; images without an item make no row.
    """
    rolled = image_rollup_stream(images, item, time, late, window).select(F.col("window").alias("__window"), F.col(item).alias("__item"), *FLAT_FEATURES)
    timed = items.withWatermark(time, late).withColumn("window", F.window(time, window))
    plain = timed.withColumn(time, F.col(time) + F.expr("interval 0 seconds"))  # a stream has one event time: the window
    own = text_features(plain, text, mode=mode)
    joined = own.join(rolled, (own["window"] == rolled["__window"]) & (own[item] == rolled["__item"]), "left_outer")
    return joined.drop("__window", "__item")


def item_features_of_windows(items: DataFrame, images: DataFrame, item: str = "item_id", text: str = "text", time: str = "ts", window: str = "1 hour", mode: str = "estimate") -> DataFrame:
    """The same over whole tables: what a stream gives when nothing is late and every window has closed."""
    kinds = {n: F.sum for n in SUMS} | {n: F.max for n in MAXIMA} | {n: F.avg for n in MEANS}
    rolled = images.where(F.col(time).isNotNull()).groupBy(F.window(time, window).alias("window"), item).agg(*[kinds[n](n).alias(n) for n in FLAT_FEATURES])
    own = text_features(items.where(F.col(time).isNotNull()).withColumn("window", F.window(time, window)), text, mode=mode)
    return own.join(rolled, ["window", item], "left").select(*own.columns, *FLAT_FEATURES)


def write_features(features: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Features as Parquet files, exactly once: the file sink's log and the checkpoint go together."""
    writer = features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
