"""Vocabularies that are tables: any rows of (domain, term), with any number of terms and of words to a term.

A text is its tokens and the gaps between them. For each number of words that terms have, the runs of so many tokens are taken
with the gaps inside them, as they stand in the text, so a term matches where it stands between characters that are no letters,
digits or underscores: what the constant vocabulary's patterns count. The runs are joined with the terms; Spark broadcasts the
table where it is small, else both sides are dealt out by term (adaptive execution splits the runs that are everywhere).

Defined results: terms are compared in lower case; terms that don't begin and end with a word character never match; null and
blank terms and domains are left out, repeated rows of the table count once; matches of one term that overlap are counted from
the left, like a pattern's; a term of several domains counts in each; domains rank by score, ties in the order of their column
ord (then name); null and blank texts have no matches; an empty vocabulary gives no rows of matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.charclass import W, all_of, is_blank
from ..functions.mathcontent import DOMAIN_BONUS, pattern_count, signs


def terms_of(vocabulary: DataFrame) -> DataFrame:
    """term, words (how many): the different terms that can match."""
    term = vocabulary.select(F.lower("term").alias("term")).where(F.col("term").rlike(f"^{W}(?s:.*{W})?$")).distinct()
    return term.select("term", F.size(all_of("term", f"{W}+")).alias("words"))


def _run(words: int):
    """From a place the run of so many tokens, with the gaps inside it."""
    return lambda i: F.struct(F.lit(words).alias("words"), i.alias("pos"), F.concat(*[x for k in range(words) for x in ([F.element_at("__gap", i + k)] if k else []) + [F.element_at("__tok", i + k)]]).alias("term"))


def table_matches(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """key, term, n: how often each term of the table stands in each text. key names a text; rows of one key are one text's parts."""
    terms = terms_of(vocabulary)
    lengths = sorted(r.words for r in terms.select("words").distinct().collect())  # a few numbers
    low = texts.select(F.col(key).alias("__key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__t")).where(~is_blank("__t"))
    split = low.select("__key", F.monotonically_increasing_id().alias("__row"), all_of("__t", f"{W}+").alias("__tok"), F.split("__t", f"{W}+", -1).alias("__gap"))
    if not lengths:
        return low.select(F.col("__key").alias(key), F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).where("false")
    kinds = []
    for words in lengths:
        size = F.size("__tok") - (words - 1)
        at = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        kinds.append(F.transform(at, _run(words)))
    # texts are read and split once for all lengths
    hits = split.select("__key", "__row", F.explode(F.concat(*kinds)).alias("x")).select("__key", "__row", "x.*").join(terms.select("term"), "term")
    if lengths == [1]:
        found = hits.groupBy("__key", "term").agg(F.count(F.lit(1)).alias("n"))
    else:
        words = F.col("words")
        places = hits.groupBy("__key", "__row", "term", "words").agg(F.count(F.lit(1)).alias("all"), F.array_sort(F.collect_list(F.when(words > 1, F.col("pos")))).alias("at"))
        start = F.struct(F.lit(0).alias("free"), F.lit(0).cast("long").alias("n"))
        left = F.aggregate("at", start, lambda a, p: F.when(p >= a["free"], F.struct((p + words).alias("free"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
        found = places.select("__key", "term", F.when(words == 1, F.col("all")).otherwise(left).alias("n")).groupBy("__key", "term").agg(F.sum("n").alias("n"))
    return found.select(F.col("__key").alias(key), "term", "n")


def domain_table(vocabulary: DataFrame) -> DataFrame:
    """domain, term, ord (of the domain; 0 where the table has none), each pair once."""
    ord_ = F.col("ord").cast("long") if "ord" in vocabulary.columns else F.lit(0).cast("long")
    rows = vocabulary.select("domain", F.lower("term").alias("term"), ord_.alias("ord")).where("domain is not null and term is not null")
    return rows.groupBy("domain", "term").agg(F.min("ord").alias("ord"))


def table_domains(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, bonus: bool = True) -> DataFrame:
    """key, primary_domain, confidence, secondary (up to two), scores (a map of those above 0), term_count, unique_terms of each text.

    bonus: patterns add to the scores of calculus, fractions and algebra, as in the constant vocabulary. A text without any score
    has the first domain; a blank one is unknown.
    """
    table = domain_table(vocabulary)
    order = table.groupBy("domain").agg(F.min("ord").alias("ord"))
    matches = table_matches(texts, key, text, vocabulary)
    scores = matches.join(table.select("domain", "term"), "term").groupBy(key, "domain").agg(F.sum("n").alias("score"))
    if bonus:
        plain = texts.select(F.col(key), F.col(text).alias("__t")).where(~is_blank("__t")).withColumn("__signs", signs("__t"))
        each = F.array(*[F.struct(F.lit(d).alias("domain"), _any(ps).cast("long").alias("score")) for d, ps in DOMAIN_BONUS.items()])
        more = plain.select(key, F.explode(each).alias("x")).select(key, "x.domain", "x.score").where("score > 0")
        scores = scores.unionByName(more.join(F.broadcast(order.where(F.col("domain").isin(*DOMAIN_BONUS))).select("domain"), "domain").select(key, "domain", "score"))
        scores = scores.groupBy(key, "domain").agg(F.sum("score").alias("score"))
    by_rank = lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["ord"] != y["ord"], F.when(x["ord"] < y["ord"], -1).otherwise(1)).when(x["domain"] < y["domain"], -1).when(x["domain"] > y["domain"], 1).otherwise(0)
    # the first three domains by order fill the ranks behind those with a score
    first = [F.struct(F.lit(r.domain).alias("domain"), F.lit(0).cast("long").alias("score"), F.lit(r.ord).cast("long").alias("ord")) for r in order.orderBy("ord", "domain").limit(3).collect()]
    entry = "array<struct<domain:string,score:bigint,ord:bigint>>"
    held = scores.join(order, "domain").groupBy(key).agg(F.collect_list(F.struct("domain", "score", "ord")).alias("__held"), F.sum("score").alias("__total"))
    counted = matches.groupBy(key).agg(F.sum("n").alias("term_count"), F.count(F.lit(1)).alias("unique_terms"))
    all_ = texts.select(F.col(key), is_blank(text).alias("__blank")).join(held, key, "left").join(counted, key, "left")
    own = F.coalesce("__held", F.array().cast(entry))
    names = F.transform(own, lambda x: x["domain"])
    ranked = F.array_sort(F.concat(own, F.filter(F.array(*first).cast(entry), lambda x: ~F.array_contains(names, x["domain"]))), by_rank)
    ranked = F.transform(ranked, lambda x: x["domain"])
    best = F.coalesce(F.array_max(F.transform(own, lambda x: x["score"])), F.lit(0))
    none = F.array().cast("array<string>")
    return all_.select(
        key,
        F.when(F.col("__blank"), "unknown").otherwise(F.try_element_at(ranked, F.lit(1))).alias("primary_domain"),
        (best / F.greatest(F.coalesce("__total", F.lit(0)), F.lit(1))).alias("confidence"),
        F.when(F.col("__blank"), none).otherwise(F.slice(ranked, 2, 2)).alias("secondary"),
        F.map_from_entries(F.transform(own, lambda x: F.struct(x["domain"], x["score"]))).alias("scores"),
        F.coalesce("term_count", F.lit(0)).alias("term_count"),
        F.coalesce("unique_terms", F.lit(0)).alias("unique_terms"),
    )


def _any(patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | (pattern_count("__t", p, "__signs") > 0)
    return out
