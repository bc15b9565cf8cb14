"""Merges of an item's parts when an item may have very many: partial results by ranges of seq, merged up a tree.

Parts are dealt out by ranges of (item, seq), whose bounds Spark finds from a sample, so an item with a million parts is spread
over many tasks and small items share them. What a task holds of an item becomes one partial result; partial results that are
neighbours are merged, FAN_IN at a time, until an item has one. Merging is associative and keeps the order of seq, so results are
those of operators.parse.merge_images and plans.item.collapse.

Defined results: parts of equal seq are merged in the order of their text (collapse) or their record's JSON (images); null seqs
come first; null texts are left out, an item of null texts only has an empty text; a null record counts as one without any
content, at confidence 0.5; items may be null; an empty table gives no rows, or the base as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import OCR_SCHEMA, record

#: Parts to a range, about, and partial results that one merge takes.
ROWS, FAN_IN = 10_000, 16
_NONE = "array<string>"


def _ranged(parts: DataFrame, keys: list[Column], rows: int) -> tuple[DataFrame, int]:
    """The parts with their range's number, __at, which rises with the keys; and how many ranges there are."""
    n = max(1, -(-parts.count() // rows))
    return parts.repartitionByRange(n, *keys).withColumn("__at", F.spark_partition_id()), n


def _up(partial: DataFrame, item: str, n: int, merge) -> DataFrame:
    """One value to each item. partial: item, __at, __v."""
    while True:
        step = F.floor(F.col("__at") / FAN_IN).cast("int")
        ordered = F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__v").alias("v"))), lambda x, y: x["at"] - y["at"])
        partial = partial.groupBy(item, step.alias("__to")).agg(merge(F.transform(ordered, lambda x: x["v"])).alias("__v")).select(item, F.col("__to").alias("__at"), "__v")
        n = -(-n // FAN_IN)
        if n == 1:
            return partial.select(item, "__v")


def collapse_ranges(parts: DataFrame, item: str, seq: str, text: str = "text", by: str = " ", rows: int = ROWS) -> DataFrame:
    """One row for each item, its texts in the order of seq, joined: plans.item.collapse for items of any number of parts."""
    ranged, n = _ranged(parts.select(item, F.col(seq).alias("__s"), F.col(text).alias("__t")), [F.col(item), F.col("__s"), F.col("__t")], rows)
    ordered = F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__s", "__t"))))
    joined = F.when(F.size(ordered) > 0, F.array_join(F.transform(ordered, lambda x: x["__t"]), by))
    partial = ranged.groupBy(item, "__at").agg(joined.alias("__v"))
    whole = _up(partial, item, n, lambda v: F.when(F.size(F.filter(v, lambda x: x.isNotNull())) > 0, F.array_join(F.filter(v, lambda x: x.isNotNull()), by)))
    return whole.select(item, F.coalesce("__v", F.lit("")).alias(text))


# ---------------------------------------------------------------- images

_LISTS = ("math_expressions", "labels", "numbers_found", "variables_found")
#: What is known of some neighbouring images: how many, their numbered descriptions, list unions, elements, choices, summed confidence.
_PARTIAL = "struct<n:bigint,described:array<struct<k:bigint,d:string>>,math_expressions:array<string>,labels:array<string>,numbers_found:array<string>,variables_found:array<string>,data_elements:array<string>,answer_choices:map<string,string>,confidence:decimal(38,18)>"


def _later_wins(a: Column, b: Column) -> Column:
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _first(x: Column) -> Column:
    """The partial result of a range's images, in order."""
    none, no_choices = F.array().cast(_NONE), F.create_map().cast("map<string,string>")
    all_of = lambda f: F.flatten(F.transform(x, lambda o: F.coalesce(o[f], none)))
    described = F.filter(F.transform(x, lambda o, i: F.struct((i + 1).cast("long").alias("k"), o["image_description"].alias("d"))), lambda d: F.coalesce(d["d"], F.lit("")) != "")
    choices = F.aggregate(x, no_choices, lambda a, o: _later_wins(a, F.coalesce(o["answer_choices"], no_choices)))
    confidence = F.aggregate(x, F.lit(0).cast("decimal(38,18)"), lambda a, o: (a + F.coalesce(o["extraction_confidence"], F.lit(0.5)).cast("decimal(38,18)")).cast("decimal(38,18)"))
    lists = [F.array_distinct(all_of(f)).alias(f) for f in _LISTS]
    return F.struct(F.size(x).cast("long").alias("n"), described.alias("described"), *lists, all_of("data_elements").alias("data_elements"), choices.alias("answer_choices"), confidence.alias("confidence")).cast(_PARTIAL)


def _merged(v: Column) -> Column:
    """Partial results of neighbours, in order, as one. Numbers of images go on from those before."""
    all_of = lambda f: F.flatten(F.transform(v, lambda x: x[f]))
    before = F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    shifted = F.flatten(F.zip_with(v, before, lambda x, b: F.transform(x["described"], lambda d: F.struct((d["k"] + b).alias("k"), d["d"].alias("d")))))
    total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    confidence = F.aggregate(v, F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x["confidence"]).cast("decimal(38,18)"))
    choices = F.aggregate(v, F.create_map().cast("map<string,string>"), lambda a, x: _later_wins(a, x["answer_choices"]))
    return F.struct(total.alias("n"), shifted.alias("described"), *[F.array_distinct(all_of(f)).alias(f) for f in _LISTS], all_of("data_elements").alias("data_elements"), choices.alias("answer_choices"), confidence.alias("confidence")).cast(_PARTIAL)


def merge_images_ranges(base: DataFrame, images: DataFrame, key: str = "doc_id", seq: str = "seq", ocr: str = "ocr", rows: int = ROWS) -> DataFrame:
    """parse.merge_images for documents of any number of images."""
    own = images.select(key, F.col(seq).alias("__s"), F.col(ocr).cast(OCR_SCHEMA).alias("__o")).withColumn("__tie", F.to_json("__o"))
    ranged, n = _ranged(own, [F.col(key), F.col("__s"), F.col("__tie")], rows)
    by_seq = F.array_sort(F.collect_list(F.struct("__s", "__tie", "__o")), lambda x, y: _order(x["__s"], y["__s"], _order(x["__tie"], y["__tie"], F.lit(0))))
    partial = ranged.groupBy(key, "__at").agg(by_seq.alias("__x")).select(key, "__at", _first(F.transform("__x", lambda x: x["__o"])).alias("__v"))
    whole = _up(partial, key, n, _merged)
    joined, o, v = base.join(whole, key, "left"), F.col(ocr), F.col("__v")
    none, no_choices = F.array().cast(_NONE), F.create_map().cast("map<string,string>")
    union = lambda f: F.array_sort(F.array_distinct(F.concat(F.coalesce(o[f], none), v[f])))
    numbered = F.transform(v["described"], lambda x: F.concat(F.lit("[Image "), x["k"].cast("string"), F.lit("] "), x["d"]))
    described = F.concat(F.when(F.coalesce(o["image_description"], F.lit("")) != "", F.array(o["image_description"])).otherwise(none), numbered)
    merged = record(
        {
            "content_type": F.lit("mixed"),
            "full_text": o["full_text"],
            "image_description": F.array_join(described, "\n"),
            "question_text": o["question_text"],
            "math_expressions": union("math_expressions"),
            "answer_choices": _later_wins(F.coalesce(o["answer_choices"], no_choices), v["answer_choices"]),
            "data_elements": F.concat(F.coalesce(o["data_elements"], none), v["data_elements"]),
            "labels": union("labels"),
            "numbers_found": union("numbers_found"),
            "variables_found": union("variables_found"),
            "extraction_confidence": F.round(0.7 * F.coalesce(o["extraction_confidence"], F.lit(0.95)) + 0.3 * (v["confidence"].cast("double") / v["n"]), 2),
        }
    )
    kept = [F.col(c) for c in base.columns if c != ocr]
    return joined.select(*kept, F.when(v.isNull(), o.cast(OCR_SCHEMA)).otherwise(merged).alias(ocr))


def _order(x: Column, y: Column, then: Column) -> Column:
    """A comparison for array_sort, nulls first."""
    return F.when(x.isNull() & y.isNull(), then).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(then)
