"""What a text holds: numbers, variables, expressions, choices, syllables, words, sentences. Column to Column, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .charclass import NOT_S, S_IN, D, S, W, all_of, col, count, digits_to_ascii, strip

NUMBER = rf"-?{D}+\.?{D}*"
VARIABLE = f"(?<!{W})[A-HJ-Zb-z](?!{W})"
WORD = f"{NOT_S}+"
ASSIGNMENT = rf"(?<![^={S_IN}])[^={S_IN}]++{S}*={S}*[^={S_IN}]+"

# The marks of LaTeX spans, opening and closing, shortest span first to close; commands; operators; the shapes of keys.
LATEX = [r"\$\$[\s\S]*?\$\$", r"\$[\s\S]*?\$", r"\\\([\s\S]*?\\\)", r"\\\[[\s\S]*?\\\]", r"\\frac\{[\s\S]*?\}\{[\s\S]*?\}", r"\\sqrt\{[\s\S]*?\}", r"\\begin\{equation\}[\s\S]*?\\end\{equation\}"]
COMMANDS = r"\\(?:int|sum|lim|log|ln|sin|cos|tan)"
OPERATIONS = "+-*/^=<>"
OPERATORS = r"[+\-−×*·÷/=<>≤≥≈^]"
SECRETS = r"AIza[A-Za-z0-9_-]{30,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}"


def numbers(text: Column | str) -> Column:
    """All numbers in order, as doubles. A hyphen right before a digit is a sign; any script's digits count."""
    other, plain = digits_to_ascii()
    found = all_of(text, NUMBER)
    as_double = lambda x: F.coalesce(x.try_cast("double"), F.translate(x, other, plain).try_cast("double"))
    return F.transform(found, as_double)


def variables(text: Column | str) -> Column:
    """Distinct single letters that stand alone, but for I and a, sorted."""
    return F.sort_array(F.array_distinct(all_of(text, VARIABLE)))


def math_expressions(text: Column | str) -> Column:
    """Distinct LaTeX spans and assignments, sorted. Each pattern reads the original text."""
    found = F.array(*[all_of(text, p) for p in LATEX], all_of(text, ASSIGNMENT))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def normalize_math_text(text: Column | str) -> Column:
    """Plain words for readability: LaTeX becomes MATH, operators and choice labels go, white space is single."""
    out = col(text)
    for p in (*LATEX, COMMANDS):
        out = F.regexp_replace(out, p, " MATH ")
    # a text without their marks has neither spans nor commands
    out = F.when(F.contains(col(text), F.lit("$")) | F.contains(col(text), F.lit("\\")), out).otherwise(col(text))
    out = F.regexp_replace(out, OPERATORS, " ")
    out = F.regexp_replace(out, rf"(?<!{W})[A-D][.)]{S}*", "")
    return strip(F.regexp_replace(out, f"{S}+", " "))


def answer_choices(text: Column | str) -> Column:
    """Map from letter to content; of repeated letters the last one counts."""
    pattern = rf"(?dms)([A-E])[.){S_IN}]+(.+?)(?=[A-E][.){S_IN}]|$)"
    pairs = F.arrays_zip(all_of(text, pattern, 1).alias("k"), all_of(text, pattern, 2).alias("v"))
    entries = F.transform(pairs, lambda x: F.struct(x["k"].alias("k"), strip(x["v"]).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda x: x["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def syllables_of_word(word: Column | str) -> Column:
    """Vowel groups, less a final e of several, at least 1; 0 for an empty word."""
    low = F.lower(col(word))
    groups = F.regexp_count(low, F.lit("[aeiou]+"))
    return F.when(low == "", F.lit(0)).otherwise(F.greatest(F.lit(1), groups - F.when(low.endswith("e") & (groups > 1), 1).otherwise(0)))


def syllables(text: Column | str) -> Column:
    """The sum over the text's words, from three counts over the text: no array of words is made."""
    low = F.lower(col(text))
    v, c = "[aeiou]", f"[^aeiou{S_IN}]"
    silent = f"(?<!{NOT_S}){c}*+{v}{NOT_S}*{c}{v}*e(?!{NOT_S})"
    voiceless = f"(?<!{NOT_S}){c}++(?!{NOT_S})"
    return count(low, f"{v}+") - count(low, silent) + count(low, voiceless)


def word_count(text: Column | str) -> Column:
    return count(text, WORD)


def sentence_count(text: Column | str) -> Column:
    """Stretches between runs of . ! ? that hold more than white space; at least 1."""
    return F.greatest(F.lit(1), count(text, f"[^.!?{S_IN}][^.!?]*+"))


def word_chars(text: Column | str) -> Column:
    return F.coalesce(F.length(F.regexp_replace(col(text), S, "")), F.lit(0))


def operation_count(text: Column | str) -> Column:
    return F.coalesce(F.length(col(text)) - F.length(F.translate(col(text), OPERATIONS, "")), F.lit(0))


def first_line(text: Column | str) -> Column:
    return F.element_at(F.split(strip(text), "\n", -1), 1)


def without_fences(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), f"```(?:json)?{S}*", ""))


def json_slice(text: Column | str) -> Column:
    """From the first brace to the last one; null if there are none."""
    return F.nullif(F.regexp_extract(without_fences(text), r"\{[\s\S]*\}", 0), F.lit(""))


def redact_secrets(text: Column | str) -> Column:
    return F.regexp_replace(col(text), SECRETS, "***")


def tokens(text: Column | str) -> Column:
    """Maximal runs of word characters of the lower-cased text."""
    return all_of(F.lower(col(text)), f"{W}+")
