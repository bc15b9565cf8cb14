"""Mathematical content of a text: patterns, symbols, vocabulary, domains. Column to Column, no UDFs."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract
from .charclass import D, S, W, all_of, col, count, is_blank
from .vocab import DOMAINS, PHRASES, SINGLE_TERMS, SYMBOLS, domain_vocabulary

#: A whole run of digits. A pattern that fails from a run's start fails from its later digits too, so only starts are tried.
RUN = f"(?<!{D}){D}++"

# Pattern names and what they count. They are anchored at the start of a run wherever that keeps them linear;
# the counts are those of the plain forms.
PATTERNS: dict[str, str] = {
    "addition": rf"{RUN}{S}*+\+{S}*+{D}+",
    "subtraction": rf"{RUN}{S}*+[-−]{S}*+{D}+",
    "multiplication": rf"{RUN}{S}*+[×*·]{S}*+{D}+",
    "division": rf"{RUN}{S}*+[÷/]{S}*+{D}+",
    "variable": extract.VARIABLE,
    "equation": r"(?<![^=])[^=]++=[^=]++",
    "inequality": r"(?<![^<>=])[^<>=]+[<>≤≥][^<>=]+",
    "exponent": rf"(?<!{W}){W}++(?:\^|\*\*)[\p{{L}}\p{{N}}_{{}}]+",
    "function": rf"(?<!{W})[a-zA-Z]++\([^)]++\)",
    "polynomial": rf"[a-z]\^?{D}*{S}*[+\-]{S}*[a-z]\^?{D}*",
    "fraction": rf"{RUN}/{D}+|\\frac\{{{D}+\}}\{{{D}+\}}",
    "decimal": rf"{RUN}\.{D}+",
    "percentage": rf"{RUN}(?:\.{D}*+)?+%",
    "ratio": rf"{RUN}:{D}+",
    "scientific_notation": rf"{RUN}(?:\.{D}*+)?+{S}*+[×x]{S}*+10\^-?{D}+",
    "derivative": r"d/dx|f'|\\frac\{d\}\{dx\}",
    "integral": r"∫|\\int",
    "limit": r"\\lim|lim_",
    "summation": r"∑|\\sum",
}


#: Of each pattern the signs without any of which a text has no match (variable: it needs none).
NEEDS: dict[str, str] = {
    "addition": "+",
    "subtraction": "-−",
    "multiplication": "×*·",
    "division": "÷/",
    "equation": "=",
    "inequality": "<>≤≥",
    "exponent": "^*",
    "function": "(",
    "polynomial": "+-",
    "fraction": "/\\",
    "decimal": ".",
    "percentage": "%",
    "ratio": ":",
    "scientific_notation": "^",
    "derivative": "/'\\",
    "integral": "∫\\",
    "limit": "\\_",
    "summation": "∑\\",
}
_SIGNS = "".join(sorted({x for y in (*NEEDS.values(), *SYMBOLS.values(), extract.OPERATIONS) for x in y}))
_NO_SIGNS = "[^" + "".join("\\" + x if x.isascii() and x != "_" and not x.isalnum() else x for x in _SIGNS) + "]+"


def signs(text: Column | str) -> Column:
    """A text's signs in order, all that symbols are counted by. Much shorter than the text, so that what follows is cheap."""
    return F.regexp_replace(col(text), _NO_SIGNS, "")


def pattern_count(text: Column | str, name: str, found: Column | str | None = None) -> Column:
    """found: the text's signs; a text without the pattern's own is not searched."""
    if found is None or name not in NEEDS:
        return count(text, PATTERNS[name])
    return F.when(reduce(lambda a, b: a | b, [F.contains(col(found), F.lit(x)) for x in NEEDS[name]]), count(text, PATTERNS[name])).otherwise(F.lit(0))


def symbol_count(text: Column | str, name: str) -> Column:
    chars = SYMBOLS[name]
    return F.coalesce(F.length(col(text)) - F.length(F.translate(col(text), chars, "")), F.lit(0))


def without_zeros(counts: dict[str, Column]) -> Column:
    """A map of the counts that are not 0."""
    pairs = [x for k, c in counts.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v > 0)


def phrase_count(lower_text: Column | str, phrase: str) -> Column:
    return count(lower_text, f"(?<!{W}){phrase}(?!{W})")


def single_hits(tokens: Column | str) -> Column:
    return F.filter(col(tokens), lambda t: t.isin(SINGLE_TERMS))


def term_hits(tokens: Column | str, lower_text: Column | str) -> Column:
    """All hits of terms in a text, with repeats: single words among the tokens, then phrases."""
    return with_phrases(single_hits(tokens), lower_text)


def with_phrases(single: Column, lower_text: Column | str) -> Column:
    phrases = [F.array_repeat(F.lit(p), phrase_count(lower_text, p)) for p in PHRASES]
    return F.when(reduce(lambda a, b: a | b, [F.contains(col(lower_text), F.lit(p)) for p in PHRASES]), F.concat(single, *phrases)).otherwise(single)


def vocabulary_matches(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n for each term in each text: the corpus path, by explode and a join with the broadcast vocabulary (85 rows)."""
    spark = texts.sparkSession
    terms = F.broadcast(domain_vocabulary(spark).select("term").distinct())
    lower = texts.select(key, F.lower(text).alias("t"))
    words = lower.select(key, F.explode(extract.tokens("t")).alias("term"))
    phrase = lambda p: F.array_repeat(F.lit(p), phrase_count("t", p))
    phrases = lower.where(F.col("t").rlike("|".join(PHRASES))).select(key, F.explode(F.concat(*map(phrase, PHRASES))).alias("term"))
    return words.unionByName(phrases).join(terms, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


#: Patterns of which any adds 1 to a domain's score.
DOMAIN_BONUS = {"calculus": ("derivative", "integral"), "fractions": ("fraction",), "algebra": ("equation", "variable")}


def domain_score(hits: Column | str, domain: str, patterns: dict[str, Column]) -> Column:
    score = F.size(F.filter(col(hits), lambda t: t.isin(DOMAINS[domain])))
    if bonus := DOMAIN_BONUS.get(domain, ()):
        score = score + reduce(lambda a, b: a | b, [patterns[p] > 0 for p in bonus]).cast("int")
    return score


def ranked_domains(scores: dict[str, Column]) -> Column:
    """Domain names by score, highest first; ties in the domains' order."""
    entries = F.array(*[F.struct((-s).alias("minus"), F.lit(k).alias("ord"), F.lit(d).alias("name")) for k, (d, s) in enumerate(scores.items())])
    return F.transform(F.sort_array(entries), lambda x: x["name"])


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_math_content(df: DataFrame, text: str = "text", prefix: str = "m_") -> DataFrame:
    """The frame with the content of its text as flat columns, in stages, so that each text scan is made once.

    Columns: {prefix}pat_*, sym_*, signs, letters (that stand alone), numbers, hits, score_*, ranked, total, blank, word_count. A blank text has none of anything.
    Columns of the frame that have these names are replaced.
    """
    p = prefix
    clean = F.when(~is_blank(text), F.col(text)).otherwise(F.lit(""))
    df = df.withColumn(f"{p}text", clean)
    df = df.withColumns({f"{p}lower": F.lower(f"{p}text"), f"{p}blank": F.col(f"{p}text") == "", f"{p}numbers": extract.numbers(f"{p}text"), f"{p}word_count": extract.word_count(f"{p}text"), f"{p}signs": signs(f"{p}text"), f"{p}letters": all_of(f"{p}text", extract.VARIABLE)})
    counts = {n: F.size(f"{p}letters") if n == "variable" else pattern_count(f"{p}text", n, f"{p}signs") for n in PATTERNS}
    # the filter keeps this wide projection out of whole-stage code, whose one method would be too long for the JVM to compile
    df = df.withColumns({f"{p}single": single_hits(all_of(f"{p}lower", f"{W}+"))} | {f"{p}pat_{n}": c for n, c in counts.items()} | {f"{p}sym_{n}": symbol_count(f"{p}signs", n) for n in SYMBOLS})
    df = df.withColumn(f"{p}hits", with_phrases(F.col(f"{p}single"), f"{p}lower"))
    patterns = {n: F.col(f"{p}pat_{n}") for n in PATTERNS}
    df = df.withColumns({f"{p}score_{d}": domain_score(f"{p}hits", d, patterns) for d in DOMAINS})
    scores = {d: F.col(f"{p}score_{d}") for d in DOMAINS}
    return df.withColumns({f"{p}ranked": ranked_domains(scores), f"{p}total": total(list(scores.values()))})


def number_range(numbers: Column | str) -> Column:
    return F.coalesce(F.array_max(col(numbers)) - F.array_min(col(numbers)), F.lit(0.0))


def has_negative(numbers: Column | str) -> Column:
    return F.exists(col(numbers), lambda x: x < 0)


def has_decimal(numbers: Column | str) -> Column:
    """A number with a fraction; one too large for a double is none."""
    return F.exists(col(numbers), lambda x: (x != F.floor(x).cast("double")) & (F.abs(x) < 1e18) & ~F.isnan(x))


def math_analysis(df: DataFrame, text: str = "text", to: str = "math") -> DataFrame:
    """The frame with the full nested record of its text in column `to`."""
    p = "__m_"
    staged = with_math_content(df, text, p)
    c = lambda n: F.col(p + n)
    blank = c("blank")
    patterns = {n: c(f"pat_{n}") for n in PATTERNS}
    symbols = {n: c(f"sym_{n}") for n in SYMBOLS}
    no_names = F.array().cast("array<string>")
    scores = F.create_map(*[x for d in DOMAINS for x in (F.lit(d), c(f"score_{d}").cast("double"))])
    record = F.struct(
        without_zeros(patterns).alias("pattern_matches"),
        without_zeros(symbols).alias("symbol_counts"),
        total(list(symbols.values())).alias("total_math_symbols"),
        total([(s > 0).cast("int") for s in symbols.values()]).alias("unique_symbol_types"),
        F.struct(F.size(c("numbers")).alias("count"), F.slice(c("numbers"), 1, 20).alias("values"), number_range(c("numbers")).alias("range"), has_negative(c("numbers")).alias("has_negative"), has_decimal(c("numbers")).alias("has_decimal")).alias("numbers"),
        F.struct(F.array_sort(F.array_distinct(c("hits"))).alias("math_terms"), F.size(c("hits")).alias("term_count"), F.size(F.array_distinct(c("hits"))).alias("unique_terms")).alias("vocabulary"),
        F.struct(
            F.when(blank, "unknown").otherwise(F.element_at(c("ranked"), 1)).alias("primary"),
            ratio(F.greatest(*[c(f"score_{d}") for d in DOMAINS]), F.greatest(c("total"), F.lit(1))).alias("confidence"),
            F.when(blank, F.create_map().cast("map<string,double>")).otherwise(scores).alias("scores"),
            F.when(blank, no_names).otherwise(F.slice(c("ranked"), 2, 2)).alias("secondary"),
        ).alias("domain_classification"),
        ratio(total(list(patterns.values())), c("word_count")).alias("math_density"),
    )
    return staged.select(*[F.col(x) for x in df.columns], record.alias(to))
