"""Readability of a text after math-aware normalisation. Column to Column, no UDFs.

mode="estimate": a grade from word and sentence lengths. mode="formula": the published formulas over the same syllable
rule (Flesch 1948, Kincaid 1975, Gunning 1952, McLaughlin 1969, Smith and Senter 1967, Coleman and Liau 1975, Linsear
Write, Dale and Chall 1948; the last needs a list of easy words). Blank texts have reading ease 50 and grade 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract
from .charclass import NOT_S, all_of, count, is_blank

METRICS = ("flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "automated_readability_index", "coleman_liau_index", "linsear_write_formula", "dale_chall_readability", "average_grade_level")
LOW_WORDS = 20
EMPTY_EASE, EMPTY_GRADE = 50.0, 8.0


def _per(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bare_word(word: Column | str) -> Column:
    """A word in lower case without what surrounds its letters and digits."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def with_readability(df: DataFrame, text: str = "text", prefix: str = "r_", mode: str = "estimate", easy_words: list[str] | None = None, syllables: str | None = None, unfamiliar: str | None = None) -> DataFrame:
    """The frame with {prefix}{metric}, {prefix}low_confidence and {prefix}estimated.

    syllables: a column with the text's number of syllables, as from with_syllables or with_word_tables; by rule where it is null or not given.
    unfamiliar: a column with the number of its words that aren't easy, as from with_word_tables, which Dale and Chall's formula
    takes; easy_words: a short list of easy words in its stead.
    Columns of the frame that have these names are replaced.
    """
    if mode not in ("estimate", "formula"):
        raise ValueError("mode is estimate or formula")
    p = prefix
    c = lambda n: F.col(p + n)
    df = df.withColumn(f"{p}norm", F.when(~is_blank(text), extract.normalize_math_text(text)))
    df = df.withColumns({f"{p}words": extract.word_count(c("norm")), f"{p}sentences": extract.sentence_count(c("norm")), f"{p}chars": extract.word_chars(c("norm")), f"{p}syllables": extract.syllables(c("norm")) if syllables is None else F.coalesce(syllables, extract.syllables(c("norm")))})
    df = df.withColumns({f"{p}asl": _per(c("words"), c("sentences")), f"{p}asw": _per(c("syllables"), c("words")), f"{p}awl": _per(c("chars"), c("words"))})
    if mode == "estimate":
        df = df.withColumn(f"{p}grade", F.greatest(F.lit(1.0), F.least(F.lit(16.0), c("awl") * 1.5 + c("asl") * 0.3 - 3.0)))
        ease = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * c("asl") - 84.6 * c("asw")))
        found = dict.fromkeys(METRICS, c("grade")) | {"flesch_reading_ease": ease, "gunning_fog": c("grade") * 1.1, "smog_index": c("grade") * 0.9}
    else:
        w, s = c("words"), c("sentences")
        df = df.withColumn(f"{p}each", all_of(c("norm"), f"{NOT_S}+")).withColumn(f"{p}syl", F.transform(c("each"), extract.syllables_of_word))
        long_words = F.size(F.filter(c("syl"), lambda x: x >= 3))
        first = F.slice(c("syl"), 1, 100)
        first_text = F.array_join(F.slice(c("each"), 1, 100), " ")
        df = df.withColumns({f"{p}hard": long_words, f"{p}linsear": _per(F.aggregate(first, F.lit(0), lambda a, x: a + F.when(x >= 3, 3).otherwise(1)), extract.sentence_count(first_text)), f"{p}letters": count(c("norm"), r"[\p{L}\p{N}]")})
        kincaid = 0.39 * c("asl") + 11.8 * c("asw") - 15.59
        fog = 0.4 * (c("asl") + 100.0 * _per(c("hard"), w))
        smog = 1.043 * F.sqrt(30.0 * _per(c("hard"), s)) + 3.1291
        if easy_words is None and unfamiliar is None:
            dale_chall = F.lit(None).cast("double")
        else:
            if unfamiliar is None:
                easy = F.array(*[F.lit(x.lower()) for x in easy_words])
                rare = F.size(F.filter(F.transform(c("each"), bare_word), lambda x: ~F.array_contains(easy, x)))
            else:
                rare = F.coalesce(unfamiliar, F.lit(0))
            share = 100.0 * _per(rare, w)
            dale_chall = 0.1579 * share + 0.0496 * c("asl") + F.when(share > 5, 3.6365).otherwise(0.0)
        found = {
            "flesch_reading_ease": 206.835 - 1.015 * c("asl") - 84.6 * c("asw"),
            "flesch_kincaid_grade": kincaid,
            "gunning_fog": fog,
            "smog_index": smog,
            "automated_readability_index": 4.71 * _per(c("letters"), w) + 0.5 * c("asl") - 21.43,
            "coleman_liau_index": 5.88 * _per(c("letters"), w) - 29.6 * _per(s, w) - 15.8,
            "linsear_write_formula": F.when(c("linsear") > 20, c("linsear") / 2).otherwise((c("linsear") - 2) / 2),
            "dale_chall_readability": dale_chall,
            "average_grade_level": (kincaid + fog + smog) / 3,
        }
    blank = c("norm").isNull()
    empty = lambda n: F.lit(EMPTY_EASE if n == "flesch_reading_ease" else EMPTY_GRADE)
    return df.withColumns({p + n: F.when(blank, empty(n)).otherwise(found[n]) for n in METRICS} | {f"{p}low_confidence": blank | (c("words") < LOW_WORDS), f"{p}estimated": ~blank & F.lit(mode == "estimate")})


def with_syllables(df: DataFrame, table: DataFrame, key: str, text: str = "text", to: str = "syllables") -> DataFrame:
    """The frame with the number of syllables of its normalised text: by a table of words where it has the word, else by rule.

    table: word (any case) and syllables, as from a pronouncing dictionary; of a word that it lists twice the least number counts.
    key: a column that names the row; rows with a null key or text have null, rows of one key share the count of all its words.
    Words are counted for each key before the join; Spark broadcasts the table only if it is small.
    """
    listed = table.select(F.lower("word").alias("__w"), F.col("syllables").cast("int").alias("__n")).groupBy("__w").agg(F.min("__n").alias("__n"))
    words = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.explode(all_of(F.lower(extract.normalize_math_text(text)), f"{NOT_S}+")).alias("__w"))
    each = words.groupBy("__k", "__w").count().join(listed, "__w", "left")
    sums = each.groupBy("__k").agg(F.sum(F.col("count") * F.coalesce("__n", extract.syllables_of_word("__w"))).alias(to))
    return df.drop(to).join(sums.hint("merge"), F.col(key) == F.col("__k"), "left").drop("__k")  # a row for each text: not for the driver


def with_word_tables(df: DataFrame, key: str, text: str = "text", easy: DataFrame | None = None, pronounced: DataFrame | None = None, syllables: str = "syllables", unfamiliar: str = "unfamiliar") -> DataFrame:
    """The frame with the numbers of its normalised text's syllables and of its words that aren't easy, from tables of any size.

    easy: word, the easy words in any case; pronounced: word and syllables, as for with_syllables. Without a table there is no such
    column. The different words of all texts are joined with both tables once, whatever the number of texts, and the dictionary
    that this gives is joined with each text's words. All joins are merge joins: these tables grow with the texts, and the driver would
    hold one that Spark finds small enough to broadcast.

    key: a column that names the row; rows with a null key or text have null, a blank text 0; rows of one key share the counts of
    all their words; null words of the tables are left out, and of a word that a table lists twice the least number counts.
    """
    # a row for each word: groups of (text, word) are nearly as many, and a task would hold all of its own
    counts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.explode(all_of(F.lower(extract.normalize_math_text(text)), f"{NOT_S}+")).alias("__w"))
    words = counts.select("__w").distinct()
    given = []
    if pronounced is not None:
        listed = pronounced.where("word is not null").select(F.lower("word").alias("__w"), F.col("syllables").cast("int").alias("__s")).groupBy("__w").agg(F.min("__s").alias("__s"))
        words = words.join(listed.hint("merge"), "__w", "left").withColumn("__s", F.coalesce("__s", extract.syllables_of_word("__w")))
        given.append(F.sum("__s").alias(syllables))
    if easy is not None:
        known = easy.where("word is not null").select(F.lower("word").alias("__b")).distinct().withColumn("__easy", F.lit(True))
        words = words.withColumn("__b", bare_word("__w")).join(known.hint("merge"), "__b", "left").drop("__b")
        given.append(F.sum(F.when(F.col("__easy"), 0).otherwise(1)).alias(unfamiliar))
    if not given:
        return df
    names = [n for n, t in ((syllables, pronounced), (unfamiliar, easy)) if t is not None]
    sums = counts.join(words.hint("merge"), "__w").groupBy("__k").agg(*given)
    joined = df.drop(*names).join(sums.hint("merge"), F.col(key) == F.col("__k"), "left")
    there = F.col(key).isNotNull() & F.col(text).isNotNull()
    return joined.withColumns({n: F.coalesce(n, F.when(there, F.lit(0))) for n in names}).drop("__k")


def readability(df: DataFrame, text: str = "text", to: str = "readability", mode: str = "estimate", easy_words: list[str] | None = None, syllables: str | None = None, unfamiliar: str | None = None) -> DataFrame:
    """The frame with all metrics as a struct in column `to`."""
    p = "__r_"
    staged = with_readability(df, text, p, mode, easy_words, syllables, unfamiliar)
    return staged.select(*[F.col(x) for x in df.columns], F.struct(*[F.col(p + n).alias(n) for n in (*METRICS, "low_confidence", "estimated")]).alias(to))
