"""Counts over texts that are too large for one row: rows of pieces, read and counted in many tasks, with the whole text's results.

A text is rows of (key, at, piece): its pieces in the order of `at`, cut anywhere between two characters. A pattern's matches must
not be cut, but a character that none of the patterns can hold parts what stands before and behind it. So each piece is counted where
it is read between its first and last such character, and only its rest, what stands before and behind, is joined with the rests of
its neighbours and counted again in the same way: first those of a few pieces, then those of more, at last those of the whole text.
Patterns of like characters share a cut (CUTS). The pieces are dealt out once; what is dealt out after that is a few words for each
piece. A piece without such a character is all rest; that a text has some now and then bounds what a row holds, not the result.

Equations, inequalities and function calls may span any length. What decides about them is the order of a few signs, so each piece
is reduced to a skeleton (signs kept, all else one filler), skeletons are joined, and the pattern is counted in the whole skeleton:
a few characters for each sign of the text.

Defined results: equal to mathcontent.pattern_count, extract.numbers (their number), word_count and sentence_count of the whole text;
null pieces are empty; pieces of one (key, at) are joined in the order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import extract
from ..functions.charclass import S_IN, W_IN, D, W, count
from ..functions.mathcontent import PATTERNS, pattern_count
from ..sources.paths import ArrowFiles, Files, _mapped, found_paths

PIECE = 4 << 20

_NUMERIC = ("addition", "subtraction", "multiplication", "division", "fraction", "decimal", "percentage", "ratio", "scientific_notation")
_WORDY = ("variable", "exponent", "polynomial", "derivative", "integral", "limit", "summation")
#: Of each cut: the characters behind which it may lie, and the counts that are made of its pieces.
CUTS: dict[str, tuple[str, dict[str, Callable[[str], Column]]]] = {
    "numeric": (rf"[^\p{{N}}{S_IN}+\-−×*·÷/.:%^x\\{{}}frac]", {p: (lambda t, p=p: pattern_count(t, p, t)) for p in _NUMERIC} | {"numbers": lambda t: count(t, extract.NUMBER)}),
    "wordy": (rf"[^{W_IN}{S_IN}^*{{}}+\-/'\\∫∑(]", {p: (lambda t, p=p: pattern_count(t, p, t)) for p in _WORDY}),
    "words": (f"[{S_IN}]", {"words": extract.word_count}),
    "sentences": ("[.!?]", {"sentences": lambda t: count(t, f"[^.!?{S_IN}][^.!?]*+")}),
}
#: Names of functions stay whole: a piece may be cut behind these.
NAME_END = f"[^{W_IN}]"
COUNTED = [m for _, made in CUTS.values() for m in made]
#: What is left of a piece: a rest for each of ENDS, and skeletons that may be joined as they are.
ENDS, NO_CUT = (*CUTS, "function"), ("equation", "inequality")
RESTS = (*ENDS, *NO_CUT)
#: The rests of this many pieces become one, then those of as many of these, then those of the text: so much a row holds at most.
BLOCK, BLOCKS = 8, 32
_CALL, _MARK = rf"(?<!{W})[a-zA-Z]++\(", ""


def skeleton(name: str, text: str) -> Column:
    """What decides about a pattern's matches, as a text in which it has as many. Skeletons of pieces make one of the whole."""
    t = F.col(text)
    if name == "equation":
        return _if_any(t, "=", _shorter(name, F.regexp_replace(t, "[^=]+", "x")), "x")
    if name == "inequality":  # as ranges, < = > and ≤ ≥ are found eight times faster than one by one
        return _if_any(t, "<>=≤≥", _shorter(name, F.regexp_replace(t, "[^<->≤-≥]+", "x")), "x")
    return _if_any(t, "()", _shorter(name, F.replace(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit(_MARK), F.lit(".")), _CALL, _MARK), f"[^{_MARK})]+", "."), F.lit(_MARK), F.lit("f("))), ".")


def _if_any(t: Column, signs: str, found: Column, filler: str) -> Column:
    """found, if the text has one of the signs, else the filler: all of it decides nothing."""
    return F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in signs]), found).when(t == "", "").otherwise(filler)


def _shorter(name: str, t: Column) -> Column:
    """Runs that decide nothing further."""
    if name == "equation":
        return F.regexp_replace(F.regexp_replace(t, "x{2,}", "x"), "={3,}", "==")
    if name == "inequality":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "x{2,}", "x"), "[≤≥]{4,}", "≤≤≤"), "([<>=])[<>=]+([<>=])", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, r"\.{2,}", "."), r"\){2,}", ")")


def _rest_shape(cut: str, t: Column) -> Column:
    """The rest of a cut as what decides about its count."""
    if cut == "words":
        return F.regexp_replace(t, f"[^{S_IN}]+", "x")
    if cut == "sentences":
        return F.regexp_replace(F.regexp_replace(t, f"[^.!?{S_IN}][^.!?]*+", "x"), f"[{S_IN}]+", "")
    return t


def _countable(cut: str, t: Column) -> Column:
    """A text in which nothing is found as an empty one: most texts have no digits, which all numeric patterns need."""
    return F.when(t.rlike(D), t).otherwise("") if cut == "numeric" else t


def _parted(df: DataFrame, keep: list[str], texts: dict[str, str]) -> DataFrame:
    """keep, and for each cut __mid_ and __rest_: what lies between the first and last safe character of its text, and the ends joined.

    A text without a safe character is all rest. Matches of the two and of the text are as many.
    """
    safe = {n: CUTS[n][0] if n in CUTS else NAME_END for n in texts}
    other = {n: f"[{p[2:]}" if p.startswith("[^") else f"[^{p[1:]}" for n, p in safe.items()}
    once = dict.fromkeys(texts.values())
    backwards = {t: F.reverse(t).alias(f"__back_{t}") for t in once}
    df = df.select(*keep, *once, *backwards.values())
    ends = [x for n, t in texts.items() for x in (F.regexp_extract(t, f"^{other[n]}*+{safe[n]}", 0).alias(f"__head_{n}"), F.reverse(F.regexp_extract(f"__back_{t}", f"^{other[n]}*+", 0)).alias(f"__tail_{n}"))]
    df = df.select(*keep, *once, *ends)
    mids = [F.substring(t, F.length(f"__head_{n}") + 1, F.length(t) - F.length(f"__head_{n}") - F.length(f"__tail_{n}")).alias(f"__mid_{n}") for n, t in texts.items()]
    between = {n: skeleton(n, f"__mid_{n}") if n == "function" else F.lit("") for n in texts}
    df = df.select(*keep, *[f"__head_{n}" for n in texts], *[f"__tail_{n}" for n in texts], *mids)
    return df.select(*keep, *[_countable(n, F.col(f"__mid_{n}")).alias(f"__mid_{n}") for n in texts if n in CUTS], *[_rest_shape(n, F.concat(f"__head_{n}", between[n], f"__tail_{n}")).alias(f"__rest_{n}") for n in texts])


def _made(prefix: str) -> dict[str, Column]:
    """The counts of all cuts, each over the column of its cut."""
    found = {m: c(f"{prefix}{n}").cast("long") for n, (_, made) in CUTS.items() for m, c in made.items()}
    # the lambda keeps this wide projection out of whole-stage code, whose one method would be too long for the JVM to compile
    return found | {"words": F.transform(F.array(found["words"]), lambda x: x)[0]}


def _joined(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rests of a group as one for each cut, in order, and the sums of what is counted."""
    rests = [f"__rest_{n}" for n in RESTS]
    ordered = F.sort_array(F.collect_list(F.struct("__at", *rests)))
    groups = df.groupBy(*keys).agg(ordered.alias("__parts"), *[F.sum(m).alias(m) for m in COUNTED])
    return groups.select(*keys, *COUNTED, *[F.array_join(f"__parts.{r}", "").alias(r) for r in rests])


def counts(pieces: DataFrame, key: str, at: str = "at", piece: str = "piece") -> DataFrame:
    """key, a column for each of the 19 patterns, numbers, words and sentences of each text."""
    numbered = isinstance(pieces.schema[at].dataType, IntegralType)
    block = lambda c, n: F.floor(F.col(c) / n) if numbered else F.lit(0).cast("long")
    plain = pieces.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.coalesce(F.col(piece), F.lit("")).alias("__t")).withColumn("__block", block("__at", BLOCK))
    own = plain.groupBy("__key", "__block", "__at").agg(F.array_join(F.array_sort(F.collect_list("__t")), "").alias("__t"))
    skeletons, between = [f"__rest_{n}" for n in NO_CUT], _made("__mid_")
    at_first = ["__key", "__block", "__at", *skeletons]
    signs = own.select("__key", "__block", "__at", "__t", *[skeleton(n, "__t").alias(f"__rest_{n}") for n in NO_CUT])
    rows = _parted(signs, at_first, dict.fromkeys(ENDS, "__t")).select(*at_first, *[c.alias(m) for m, c in between.items()], *[f"__rest_{n}" for n in ENDS])
    for size in (BLOCKS, None):
        before = ["__key", "__block", *[f"__n_{m}" for m in COUNTED], *skeletons]
        joined = _joined(rows, ["__key", "__block"]).select("__key", "__block", *[F.col(m).alias(f"__n_{m}") for m in COUNTED], *[_shorter(n, F.col(f"__rest_{n}")).alias(f"__rest_{n}") for n in NO_CUT], *[F.col(f"__rest_{n}").alias(f"__t_{n}") for n in ENDS])
        parted = _parted(joined, before, {n: f"__t_{n}" for n in ENDS})
        rows = parted.select("__key", F.col("__block").alias("__at"), *[(F.col(f"__n_{m}") + c).alias(m) for m, c in between.items()], *[f"__rest_{n}" for n in RESTS])
        if size:
            rows = rows.withColumn("__block", block("__at", size))
    whole = _joined(rows, ["__key"])
    whole = whole.withColumns({f"__rest_{n}": _shorter(n, F.col(f"__rest_{n}")) for n in NO_CUT} | {"__rest_function": skeleton("function", "__rest_function")})
    found = {m: F.col(m) + c for m, c in _made("__rest_").items()} | {n: pattern_count(f"__rest_{n}", n).cast("long") for n in (*NO_CUT, "function")}
    return whole.select(F.col("__key").alias(key), *[found[n].alias(n) for n in (*PATTERNS, "numbers", "words")], F.greatest(F.lit(1), found["sentences"]).alias("sentences"))


# ---------------------------------------------------------------- pieces of files


class RangedFiles(ArrowFiles):
    """Also reads parts of files."""

    def read_range(self, path: str, start: int, length: int) -> bytes:
        system, at = self.at(path)
        with system.open_input_file(at) as f:
            f.seek(start)
            return f.read(length)


def read_pieces(paths: DataFrame, column: str = "path", size: int = PIECE, files: Callable[[], Files] = RangedFiles) -> DataFrame:
    """path, at, piece: UTF-8 text files of any size, read in ranges of bytes by many tasks. Cuts move to the next character."""
    found = found_paths(paths, column, files).where("kind = 'text' and error is null and size > 0")
    ranges = found.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {size}"))).alias("at"))
    tasks = ranges.repartition(max(1, ranges.count()), "path", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = files()
        for batch in batches:
            for path, _, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = own.read_range(path, at * size, size + 3)  # a character has four bytes at most
                start, end = (0 if at == 0 else _head(raw)), min(size, len(raw))
                end += _head(raw[end:]) if len(raw) > end else 0
                yield [(path, at, raw[start:end].decode("utf-8", "replace"))]

    return _mapped(tasks, read, "path string, at long, piece string")


def _head(raw: bytes) -> int:
    """Bytes of a character that began before, at most three."""
    return next((k for k, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), min(3, len(raw)))
