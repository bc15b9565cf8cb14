"""Raw load indicators of a text. Column to Column, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract
from .charclass import is_blank
from .vocab import KEYWORDS

FIELDS = ("numeric_elements", "variable_count", "operation_count", "word_count", "sentence_count", "math_term_count", "element_density", "avg_sentence_length")


def keyword_count(tokens: Column) -> Column:
    """Distinct keywords among the tokens."""
    return F.size(F.array_distinct(F.filter(tokens, lambda t: t.isin(KEYWORDS))))


def with_cognitive_load(df: DataFrame, text: str = "text", prefix: str = "c_", terms: str | None = None) -> DataFrame:
    """The frame with {prefix}{field}. terms: a column of found terms; where it is null or empty, keywords are counted.

    Columns of the frame that have these names are replaced.
    """
    p = prefix
    c = lambda n: F.col(p + n)
    df = df.withColumns({f"{p}blank": is_blank(text)})
    counts = {
        "numeric_elements": F.size(F.regexp_extract_all(text, F.lit(extract.NUMBER), F.lit(0))),
        "variable_count": F.size(extract.variables(text)),
        "operation_count": extract.operation_count(text),
        "word_count": extract.word_count(text),
        "sentence_count": extract.sentence_count(text),
    }
    found = keyword_count(extract.tokens(text))
    if terms is not None:
        found = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, F.size(terms)).otherwise(found)
    df = df.withColumns({p + n: F.when(c("blank"), 0).otherwise(x) for n, x in (counts | {"math_term_count": found}).items()})
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return df.withColumns({f"{p}element_density": per(c("numeric_elements") + c("variable_count"), c("word_count")), f"{p}avg_sentence_length": per(c("word_count"), c("sentence_count"))})


def cognitive_load(df: DataFrame, text: str = "text", to: str = "cognitive", terms: str | None = None) -> DataFrame:
    """The frame with all indicators as a struct in column `to`."""
    p = "__c_"
    staged = with_cognitive_load(df, text, p, terms)
    return staged.select(*[F.col(x) for x in df.columns], F.struct(*[F.col(p + n).alias(n) for n in FIELDS]).alias(to))
