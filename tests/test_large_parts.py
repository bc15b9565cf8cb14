"""Items of very many parts, and vocabularies that are tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from itemloom.functions.vocab import domain_vocabulary
from itemloom.operators import ranges, vocabulary
from itemloom.operators.parse import OCR_SCHEMA, merge_images
from itemloom.plans import queries as q
from itemloom.plans.item import collapse


@pytest.mark.parametrize("rows,fan_in", [(50, 2), (10_000, 16)])
def test_collapse_by_ranges(spark, monkeypatch, rows, fan_in):
    monkeypatch.setattr(ranges, "FAN_IN", fan_in)
    r = random.Random(1)
    parts = [("big", r.randrange(400), r.choice(["x", "y", None, ""]) and f"t{k}") for k in range(900)] + [(f"i{k}", k % 3, f"u{k}") for k in range(60)] + [("nulls", 1, None), ("nulls", 2, None), (None, 5, "b"), (None, None, "a"), ("e", 1, "")]
    df = spark.createDataFrame(parts, "item string, seq int, text string").repartition(5)
    want = sorted(map(repr, map(tuple, collapse(df, "item", "seq").collect())))
    assert sorted(map(repr, map(tuple, ranges.collapse_ranges(df, "item", "seq", rows=rows).collect()))) == want
    assert ranges.collapse_ranges(df.where("false"), "item", "seq").count() == 0


@pytest.mark.parametrize("rows,fan_in", [(40, 3), (10_000, 16)])
def test_merges_by_ranges(spark, monkeypatch, rows, fan_in):
    monkeypatch.setattr(ranges, "FAN_IN", fan_in)
    r = random.Random(2)

    def ocr(k):
        words = lambda n: r.choice([None, [], [f"w{r.randrange(9)}" for _ in range(r.randrange(n))]])
        return ("text_only", f"full {k}", r.choice([None, "", f"seen {k}"]), "q", words(4), r.choice([None, {}, {r.choice("ABC"): f"{k}"}]), words(3), words(3), words(5), words(2), r.choice([None, 0.25, 0.5, 0.875]))

    images = [("big", k, ocr(k)) for k in range(700)] + [(f"d{k % 9}", k, ocr(k)) for k in range(40)] + [("null", 1, None), ("nobody", 1, ocr(1))]
    r.shuffle(images)
    base = [(n, ocr(0), "kept") for n in ("big", "null", "alone", *(f"d{k}" for k in range(9)))]
    i = spark.createDataFrame(images, f"doc_id string, seq int, ocr {OCR_SCHEMA}").repartition(6)
    b = spark.createDataFrame(base, f"doc_id string, ocr {OCR_SCHEMA}, more string")
    want = {x.doc_id: x for x in merge_images(b, i).collect()}
    got = {x.doc_id: x for x in ranges.merge_images_ranges(b, i, rows=rows).collect()}
    assert got == want and len(want) == 12
    assert "[Image 700]" in got["big"].ocr.image_description or images
    assert {x.doc_id: x.ocr for x in ranges.merge_images_ranges(b, i.where("false")).collect()} == {x.doc_id: x.ocr for x in merge_images(b, i.where("false")).collect()}


def test_no_task_reads_a_large_item_whole(spark):
    """A million parts of one item: each range holds its share."""
    parts = spark.range(1_000_000).selectExpr("'one' as item", "(id * 7919) % 1000000 as seq", "cast(id % 10 as string) as text")
    ranged, n = ranges._ranged(parts.select("item", F.col("seq").alias("__s"), F.col("text").alias("__t")), [F.col("item"), F.col("__s"), F.col("__t")], 50_000)
    held = [x["count"] for x in ranged.groupBy("__at").count().collect()]
    assert n == 20 and len(held) >= 18 and max(held) < 100_000
    got = ranges.collapse_ranges(parts, "item", "seq", by="", rows=50_000).first().text
    order = sorted(range(1_000_000), key=lambda k: k * 7919 % 1_000_000)
    assert got == "".join(str(k % 10) for k in order)


# ---------------------------------------------------------------- vocabularies


def test_table_equals_the_constant_vocabulary(spark, sf_dir):
    items = q.items(spark, sf_dir).select("item_id", "txt").unionByName(spark.createDataFrame([(-1, "Place value, place  value and PLACE VALUE; place-value. placevalue x_mean mean"), (-2, None), (-3, " "), (-4, "standard deviation deviation"), (-5, "nothing of it")], "item_id long, txt string"))
    from itemloom.functions.mathcontent import with_math_content

    content = with_math_content(items, "txt").select("item_id", F.when(F.col("m_blank"), "unknown").otherwise(F.element_at("m_ranked", 1)).alias("p"), F.when(F.col("m_blank"), F.array().cast("array<string>")).otherwise(F.slice("m_ranked", 2, 2)).alias("s"), F.size("m_hits").alias("n"), F.size(F.array_distinct("m_hits")).alias("u"), "m_total")
    want = {r.item_id: (r.p, r.s, r.n, r.u, r.m_total) for r in content.collect()}
    got = vocabulary.table_domains(items, "item_id", "txt", domain_vocabulary(spark)).collect()
    assert {r.item_id: (r.primary_domain, r.secondary, r.term_count, r.unique_terms, sum(r.scores.values())) for r in got} == want and len(got) == len(want)


def plain_counts(texts, terms):
    word = r"[^\W]"
    out = {}
    for k, t in texts:
        for term in terms:
            n = len(re.findall(rf"(?<!{word}){re.escape(term)}(?!{word})", (t or "").lower()))
            if n:
                out[k, term] = n
    return out


def test_large_vocabulary_against_brute_force(spark):
    """100,000 terms of one to four words, odd ones among them; what occurs is counted by patterns."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    texts = [(k, "".join(r.choice(words).upper() if r.random() < 0.1 else r.choice(words) + r.choice([" ", " ", " ", "  ", "-", ", ", "_"]) for _ in range(r.randrange(0, 60)))) for k in range(60)] + [(90, None), (91, " \t"), (92, "ax ax ax ax ax"), (93, "ax-by")]
    terms = {" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 2, 3) for _ in range(300)} | {"ax ax", "ax ax ax", "ax-by", "AX", "bz, cx"}
    many = [(f"d{k % 50}", f"term {k}") for k in range(100_000)] + [("d1", t) for t in terms] + [("d1", "ax"), ("d2", None), (None, "ax"), ("d3", " "), ("d3", "-"), ("d3", "ax!"), ("d3", "")]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    table = spark.createDataFrame(many, "domain string, term string")
    want = plain_counts(texts, {t.lower() for t in terms})
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = {(x.id, x.term): x.n for x in vocabulary.table_matches(df, "id", "t", table).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == want and len(want) > 100
    ranked = {x.id: x for x in vocabulary.table_domains(df, "id", "t", table, bonus=False).collect()}
    assert ranked[92].scores == {"d1": 5 + 2 + 1} and ranked[92].primary_domain == "d1" and ranked[92].secondary == ["d0", "d10"] and ranked[90].primary_domain == "unknown"
    assert vocabulary.table_matches(df, "id", "t", table.where("false")).count() == 0
    assert {x.primary_domain for x in vocabulary.table_domains(df, "id", "t", table.where("false")).collect()} == {None, "unknown"}
