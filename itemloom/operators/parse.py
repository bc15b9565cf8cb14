"""Parsing of vision-model responses, and the merge of image results into their document. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.charclass import NOT_S, col, strip
from ..functions.vocab import MODEL_NAMES

OCR_SCHEMA = "struct<content_type:string,full_text:string,image_description:string,question_text:string,math_expressions:array<string>,answer_choices:map<string,string>,data_elements:array<string>,labels:array<string>,numbers_found:array<string>,variables_found:array<string>,extraction_confidence:double>"
_LISTS = ("math_expressions", "data_elements", "labels", "numbers_found", "variables_found")


def _strings(x: Column) -> Column:
    return x.cast("array<string>")


def empty_ocr(content_type: str = "text_only", confidence: float = 0.0) -> dict[str, Column]:
    none = F.array().cast("array<string>")
    return {
        "content_type": F.lit(content_type),
        "full_text": F.lit(""),
        "image_description": F.lit(""),
        "question_text": F.lit(""),
        "math_expressions": none,
        "answer_choices": F.create_map().cast("map<string,string>"),
        "data_elements": none,
        "labels": none,
        "numbers_found": none,
        "variables_found": none,
        "extraction_confidence": F.lit(confidence),
    }


def record(fields: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(OCR_SCHEMA)


def with_ocr(df: DataFrame, response: str, to: str = "ocr") -> DataFrame:
    """The frame with a response's record in column `to`.

    JSON gives its own fields (absent ones null); a missing content_type follows from which texts aren't blank. Anything else
    is taken as plain text, at confidence 0.5. A null response is an empty one.
    """
    text = strip(F.coalesce(F.col(response), F.lit("")))
    staged = df.withColumn("__text", text).withColumn("__raw", extract.json_slice(F.coalesce(F.col(response), F.lit(""))))
    staged = staged.withColumn("__map", F.from_json("__raw", "map<string,string>")).withColumn("__json", F.from_json("__raw", OCR_SCHEMA.replace("struct<", "", 1)[:-1].replace(":", " ")))
    filled = lambda n: F.coalesce(F.col(f"__json.{n}"), F.lit("")).rlike(NOT_S)
    guessed = F.when(filled("full_text") & filled("image_description"), "mixed").when(filled("full_text"), "text_only").otherwise("image_only")
    own = {f: F.col(f"__json.{f}") for f in ("full_text", "image_description", "question_text", *_LISTS, "answer_choices", "extraction_confidence")}
    parsed = record({"content_type": F.coalesce(F.nullif(F.col("__json.content_type"), F.lit("")), guessed)} | {f: own[f] for f in ("full_text", "image_description", "question_text", "math_expressions", "answer_choices", "data_elements", "labels", "numbers_found", "variables_found", "extraction_confidence")})
    t = F.col("__text")
    has_text = t.rlike("[a-zA-Z0-9]{3,}")
    plain = record(
        empty_ocr(confidence=0.5)
        | {
            "content_type": F.when(has_text, "text_only").otherwise("image_only"),
            "full_text": F.when(has_text, t).otherwise(""),
            "image_description": F.when(has_text, "").otherwise(t),
            "question_text": F.when(has_text, t).otherwise(""),
            "math_expressions": extract.math_expressions(t),
            "answer_choices": extract.answer_choices(t),
            "numbers_found": _strings(extract.numbers(t)),
            "variables_found": extract.variables(t),
        }
    )
    is_json = F.col("__raw").isNotNull() & F.col("__map").isNotNull()
    return staged.select(*[F.col(c) for c in df.columns], F.when(is_json, parsed).otherwise(plain).alias(to))


def truthy(raw: Column) -> Column:
    """Whether a JSON value counts as true, from its raw text (a quoted "false" does)."""
    return F.coalesce(~raw.isin("false", "null", "0", "0.0", "-0", "-0.0", '""', "[]", "{}", ""), F.lit(False))


def with_classification(df: DataFrame, response: str, to: str = "models") -> DataFrame:
    """The frame with 20 booleans, primary and model_count in column `to`. No JSON, or JSON that doesn't parse: all false, other."""
    raw = extract.json_slice(F.coalesce(F.col(response), F.lit("")))
    staged = df.withColumn("__raw", raw).withColumn("__map", F.from_json("__raw", "map<string,string>"))
    quoted = lambda m: F.get_json_object("__raw", f"$.{m}")
    value = lambda m: F.when(F.map_contains_key("__map", m), F.coalesce(F.try_element_at("__map", F.lit(m)), F.lit("null")))
    flags = {}
    for m in MODEL_NAMES:
        is_string = F.col("__raw").rlike(rf'"{m}"\s*:\s*"')
        flags[m] = F.when(is_string, F.coalesce(quoted(m) != "", F.lit(False))).otherwise(truthy(F.coalesce(value(m), F.lit("null"))))
        flags[m] = F.coalesce(flags[m] & F.col("__map").isNotNull(), F.lit(False))
    primary = F.try_element_at("__map", F.lit("primary"))
    allowed = F.when(primary.isin([*MODEL_NAMES, "text_only"]), primary).otherwise("other")
    staged = staged.withColumn("__flags", F.struct(*[c.alias(m) for m, c in flags.items()]))
    n = reduce(lambda a, b: a + b, [F.col(f"__flags.{m}").cast("int") for m in MODEL_NAMES])
    return staged.select(*[F.col(c) for c in df.columns], F.struct(*[F.col(f"__flags.{m}").alias(m) for m in MODEL_NAMES], allowed.alias("primary"), n.alias("model_count")).alias(to))


def text_only_classification() -> Column:
    """The result for an item without images."""
    return F.struct(*[F.lit(False).alias(m) for m in MODEL_NAMES], F.lit("text_only").alias("primary"), F.lit(0).alias("model_count"))


def merge_images(base: DataFrame, images: DataFrame, key: str = "doc_id", seq: str = "seq", ocr: str = "ocr") -> DataFrame:
    """The base documents with the results of their images merged in. Documents without images stay as they are.

    Numbers of image descriptions count images without one too. Lists become sorted unions, data elements are appended,
    choices of later images win, confidence is 0.7 of the text's and 0.3 of the images' mean (0.5 where an image has none).
    """
    by_seq = lambda x, y: F.when(x["s"] < y["s"], -1).when(x["s"] > y["s"], 1).otherwise(0)
    each = images.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(ocr).alias("o"))), by_seq).alias("imgs"))
    joined = base.join(each, key, "left")
    imgs, own = F.col("imgs"), F.col(ocr)
    none = F.array().cast("array<string>")
    lists = lambda f: F.flatten(F.transform(imgs, lambda x: F.coalesce(x["o"][f], none)))
    union = lambda f: F.array_sort(F.array_distinct(F.concat(F.coalesce(own[f], none), lists(f))))
    numbered = F.transform(imgs, lambda x, i: F.when(F.coalesce(x["o"]["image_description"], F.lit("")) != "", F.concat(F.lit("[Image "), (i + 1).cast("string"), F.lit("] "), x["o"]["image_description"])))
    described = F.concat(F.array(F.nullif(own["image_description"], F.lit(""))), numbered)
    no_choices = F.create_map().cast("map<string,string>")
    choices = F.aggregate(imgs, F.coalesce(own["answer_choices"], no_choices), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: ~F.coalesce(F.map_contains_key(x["o"]["answer_choices"], k), F.lit(False))), F.coalesce(x["o"]["answer_choices"], no_choices)))
    mean = F.aggregate(imgs, F.lit(0.0), lambda a, x: a + F.coalesce(x["o"]["extraction_confidence"], F.lit(0.5))) / F.size(imgs)
    merged = record(
        {
            "content_type": F.lit("mixed"),
            "full_text": own["full_text"],
            "image_description": F.array_join(F.filter(described, lambda x: x.isNotNull()), "\n"),
            "question_text": own["question_text"],
            "math_expressions": union("math_expressions"),
            "answer_choices": choices,
            "data_elements": F.concat(F.coalesce(own["data_elements"], none), lists("data_elements")),
            "labels": union("labels"),
            "numbers_found": union("numbers_found"),
            "variables_found": union("variables_found"),
            "extraction_confidence": F.round(0.7 * F.coalesce(own["extraction_confidence"], F.lit(0.95)) + 0.3 * mean, 2),
        }
    )
    kept = [F.col(c) for c in base.columns if c != ocr]
    return joined.select(*kept, F.when(imgs.isNull(), own.cast(OCR_SCHEMA)).otherwise(merged).alias(ocr))


def safe_get(json: Column | str, keys: list[str], default: str | None = None) -> Column:
    """A nested value of a JSON text. The default holds where a key is absent or no object; a null that is there stays null."""
    at = F.from_json(col(json), "map<string,string>")
    for k in keys[:-1]:
        at = F.from_json(F.try_element_at(at, F.lit(k)), "map<string,string>")
    there = F.coalesce(F.map_contains_key(at, keys[-1]), F.lit(False))
    return F.when(there, F.try_element_at(at, F.lit(keys[-1]))).otherwise(F.lit(default))
