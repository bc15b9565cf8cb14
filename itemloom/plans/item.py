"""The item row: text features, and image features rolled up to items. One projection in stages; a shuffle only for images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cognitive import with_cognitive_load
from ..functions.extract import operation_count, sentence_count
from ..functions.mathcontent import has_decimal, has_negative, number_range, ratio, total, with_math_content
from ..functions.readability import with_readability
from ..functions.vocab import DOMAINS, SYMBOLS
from ..operators.visual import FLAT_FEATURES, rollup

__all__ = ["collapse", "item_features", "text_features", "with_cognitive_load"]

PATTERNS_KEPT = ("equation", "fraction", "variable", "percentage", "ratio", "exponent")
READABILITY = {
    "readability_flesch_kincaid_grade": "flesch_kincaid_grade",
    "readability_avg_grade_level": "average_grade_level",
    "readability_flesch_reading_ease": "flesch_reading_ease",
    "readability_gunning_fog": "gunning_fog",
    "readability_smog_index": "smog_index",
    "readability_coleman_liau": "coleman_liau_index",
    "readability_ari": "automated_readability_index",
    "readability_dale_chall": "dale_chall_readability",
}


def collapse(parts: DataFrame, item: str, seq: str, text: str = "text", by: str = " ") -> DataFrame:
    """One row for each item: its texts in the order of seq, joined. Null texts are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(text).alias("t")))))
    return parts.groupBy(item).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), by).alias(text))


def text_features(items: DataFrame, text: str = "text", keep: list[str] | None = None, mode: str = "estimate", syllables: str | None = None, unfamiliar: str | None = None) -> DataFrame:
    """The kept columns (all but the text by default) and 34 feature columns, which replace kept ones of their names.

    syllables, unfamiliar: columns with what tables of words say of each text, as from functions.readability.with_word_tables.
    """
    given = [c for c in (syllables, unfamiliar) if c is not None]
    keep = [c for c in items.columns if c != text and c not in given] if keep is None else keep
    df = items.select(*keep, F.col(text).alias("__t"), *[F.col(c).alias(f"__given_{k}") for k, c in (("syllables", syllables), ("unfamiliar", unfamiliar)) if c is not None])
    df = with_math_content(df, "__t", "__m_")
    df = with_readability(df, "__t", "__r_", mode, syllables="__given_syllables" if syllables else None, unfamiliar="__given_unfamiliar" if unfamiliar else None)
    m = lambda n: F.col(f"__m_{n}")
    blank = m("blank")
    df = df.withColumns({"__vars": F.size(F.array_distinct(m("letters"))), "__ops": operation_count(m("signs")), "__sent": F.when(blank, 0).otherwise(sentence_count(m("text"))), "__uniq": F.size(F.array_distinct(m("hits"))), "__best": F.greatest(*[m(f"score_{d}") for d in DOMAINS])})
    symbols = [m(f"sym_{s}") for s in SYMBOLS]
    number_count = F.size(m("numbers"))
    features: dict[str, Column] = {k: F.col(f"__r_{v}") for k, v in READABILITY.items()}
    features |= {
        "readability_low_confidence": F.col("__r_low_confidence").cast("int"),
        "math_density": ratio(total([F.col(c) for c in df.columns if c.startswith("__m_pat_")]), m("word_count")),
        "math_total_symbols": total(symbols),
        "math_unique_symbol_types": total([(s > 0).cast("int") for s in symbols]),
        "math_numbers_count": number_count,
        "math_numbers_range": number_range(m("numbers")),
        "math_has_negative": has_negative(m("numbers")).cast("int"),
        "math_has_decimal": has_decimal(m("numbers")).cast("int"),
        "math_vocab_unique_terms": F.col("__uniq"),
        "math_vocab_term_count": F.size(m("hits")),
        "math_domain_primary": F.when(blank, "unknown").otherwise(F.element_at(m("ranked"), 1)),
        "math_domain_confidence": ratio(F.col("__best"), F.greatest(m("total"), F.lit(1))),
    }
    features |= {f"math_pat_{n}": m(f"pat_{n}") for n in PATTERNS_KEPT}
    features |= {
        "cognitive_numeric_elements": number_count,
        "cognitive_variable_count": F.col("__vars"),
        "cognitive_operation_count": F.col("__ops"),
        "cognitive_word_count": m("word_count"),
        "cognitive_sentence_count": F.col("__sent"),
        "cognitive_math_term_count": F.col("__uniq"),  # every keyword is a term, so the keyword fallback adds nothing here
        "cognitive_element_density": ratio(number_count + F.col("__vars"), m("word_count")),
        "cognitive_avg_sentence_length": ratio(m("word_count"), F.col("__sent")),
    }
    names = {n.lower() for n in features}
    return df.select(*[k for k in keep if k.lower() not in names], *[c.alias(n) for n, c in features.items()])


def item_features(items: DataFrame, images: DataFrame | None = None, item: str = "item_id", text: str = "text", mode: str = "estimate", syllables: str | None = None, unfamiliar: str | None = None) -> DataFrame:
    """The full row of 45 features. images: item and the 11 flat features of each of its images (see operators.visual).

    Items without images have null visual features.
    """
    found = text_features(items, text, mode=mode, syllables=syllables, unfamiliar=unfamiliar)
    if images is None:
        return found.select("*", *[F.lit(None).cast("double").alias(n) for n in FLAT_FEATURES])
    return found.join(rollup(images, item), item, "left")
