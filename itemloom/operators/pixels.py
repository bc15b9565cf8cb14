"""Pixel statistics by histograms, without Python: exact mean, deviation and median of an image, and of an item's images together.

A pixel's level is the sum of its first three channels (three times the value where there is one), a whole number up to 765, so
a third of it is the mean of the channels. An image's rows of pixels are spelled in hexadecimal and taken apart by the JVM; pixels
of one colour are counted before anything is shuffled. Histograms have at most 766 levels, however many pixels they count, and
add up: those of parts, of images, of days. Statistics are computed from their sums, in whole numbers up to the last division.

Defined results: images that can't be read (no height, no data, data of another length) have sizes and statistics of null, as
operators.visual has them; a group without any readable image has none; a null item is a group; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def readable(image: Column) -> Column:
    """Whether an image of Spark's image source holds the pixels that its sizes promise."""
    sizes = (image["height"] >= 1) & (image["width"] >= 1) & (image["nChannels"] >= 1)
    return F.coalesce(sizes & (F.octet_length(image["data"]) == image["height"].cast("long") * image["width"] * image["nChannels"]), F.lit(False))


def histograms(images: DataFrame, keys: list[str], image: str = "image") -> DataFrame:
    """keys, level, n: how many pixels of each level the images of a group hold."""
    i = F.col(image)
    own = images.where(readable(i)).select(*keys, i["nChannels"].alias("__c"), i["width"].alias("__w"), i["height"].alias("__h"), i["data"].alias("__d"))
    line = F.transform(F.sequence(F.lit(0), F.col("__h") - 1), lambda r: F.hex(F.substring(F.col("__d"), r * F.col("__w") * F.col("__c") + 1, F.col("__w") * F.col("__c"))))
    lines = own.select(*keys, "__c", F.explode(line).alias("__x"))
    pixels = lines.select(*keys, "__c", F.explode(F.expr("regexp_extract_all(__x, concat('.{', 2 * __c, '}'), 0)")).alias("__p"))
    colours = pixels.groupBy(*keys, "__c", "__p").agg(F.count(F.lit(1)).alias("n"))
    at = lambda k: F.conv(F.substring("__p", 2 * k + 1, 2), 16, 10).cast("long")
    level = F.when(F.col("__c") == 1, 3 * at(0)).when(F.col("__c") == 2, at(0) + at(1)).otherwise(at(0) + at(1) + at(2))
    return colours.withColumn("level", level).groupBy(*keys, "level").agg(F.sum("n").alias("n"))


def merged(found: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of several parts as one, for each group of keys."""
    return found.groupBy(*keys, "level").agg(F.sum("n").alias("n"))


def statistics(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pixels, mean, std, min, max, median, contrast from histograms with a row for each group and level."""
    upto = Window.partitionBy(*keys).orderBy("level")
    sums = found.withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    # the two middle pixels; of an odd number they are the same
    middle = lambda at: F.min(F.when(F.col("__upto") >= at, F.col("level")))
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    level = F.col("level")
    found = sums.groupBy(*keys).agg(
        F.sum("n").alias("pixels"),
        whole(level * F.col("n")).alias("__s"),
        whole(level * level * F.col("n")).alias("__q"),
        F.min("level").alias("__low"),
        F.max("level").alias("__high"),
        middle(F.floor((F.col("__all") + 1) / 2)).alias("__m"),
        middle(F.floor((F.col("__all") + 2) / 2)).alias("__k"),
    )
    n = F.col("pixels").cast("double")
    spread = (F.col("pixels").cast("decimal(19,0)") * F.col("__q").cast("decimal(19,0)") - F.col("__s").cast("decimal(19,0)") * F.col("__s").cast("decimal(19,0)")).cast("double")
    return found.select(
        *keys,
        "pixels",
        (F.col("__s").cast("double") / n / 3).alias("mean"),
        (F.sqrt(spread) / n / 3).alias("std"),
        (F.col("__low") / 3).alias("min"),
        (F.col("__high") / 3).alias("max"),
        ((F.col("__m") + F.col("__k")) / 6).alias("median"),
        ((F.col("__high") - F.col("__low")) / 3).alias("contrast"),
    )


def pixel_statistics(images: DataFrame, key: str, image: str = "image") -> DataFrame:
    """key, width, height, aspect_ratio, pixels and the statistics of each image. key names an image."""
    i, good = F.col(image), readable(F.col(image))
    sizes = images.select(key, F.when(good, i["width"]).alias("width"), F.when(good, i["height"]).alias("height"))
    ratio = F.round(F.col("width") / F.col("height"), 3).alias("aspect_ratio")
    return sizes.join(statistics(histograms(images, [key], image), [key]), key, "left").select(key, "width", "height", ratio, "pixels", "mean", "std", "min", "max", "median", "contrast")


def item_statistics(images: DataFrame, item: str, image: str = "image") -> DataFrame:
    """item, images (readable ones), pixels and the statistics of all pixels of an item's images together."""
    counts = images.groupBy(item).agg(F.sum(readable(F.col(image)).cast("long")).alias("images"))
    found = statistics(histograms(images, [item], image), [item])
    same = counts[item].eqNullSafe(found[item])
    return counts.join(found, same, "left").select(counts[item], "images", "pixels", "mean", "std", "min", "max", "median", "contrast")
