"""Counts over pieces equal those of the whole text."""

import random

import pytest
from pyspark.sql import functions as F

from itemloom.functions import extract
from itemloom.functions.mathcontent import PATTERNS, pattern_count
from itemloom.operators import large_texts as lt

MARKS = ["+", "-", "−", "×", "*", "·", "÷", "/", "=", "==", "<", ">", "≤", "≥", "^", "**", "(", ")", "{", "}", ".", ":", "%", "\\frac", "\\int", "\\lim", "lim_", "\\sum", "∫", "∑", "d/dx", "f'", "{d}{dx}", " ", "  ", "\n", ",", ";", "!", "?", "x", "10^", "g(", "h(x)", "()", "_", "é", "٣", "½", "", "(" * 3, ")" * 3, "≤≤≤≤≤", "=====", "<=>=<", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1" * 30]


def whole(spark, texts):
    df = spark.createDataFrame(texts, "id int, t string")
    return df.select("id", *[pattern_count("t", p).cast("long").alias(p) for p in PATTERNS], F.size(extract.numbers("t")).cast("long").alias("numbers"), extract.word_count("t").cast("long").alias("words"), extract.sentence_count("t").cast("long").alias("sentences"))


@pytest.mark.parametrize("size", [1, 3, 7])
def test_pieces_equal_the_whole(spark, size):
    r = random.Random(size)
    token = lambda: r.choice(MARKS) if r.random() < 0.6 else r.choice(["1", "22", "3.5", "a", "b", "word", "Abc", "x2", "12:30", "y"])
    texts = [(k, "".join(token() + r.choice(["", "", " "]) for _ in range(r.randrange(1, 50)))) for k in range(150)]
    texts += [(900, "a=b=c=d=e"), (901, "=" * 50 + "a=b" + "=" * 20), (902, "f(" * 20 + ")" * 20), (903, "1" * 60), (904, " "), (905, "x" * 70), (906, "a<b" * 20), (907, "plain words. And more! Yes?")]
    pieces = [(k, at, t[s : s + size]) for k, t in texts for at, s in enumerate(range(0, len(t), size))]
    r.shuffle(pieces)
    df = spark.createDataFrame(pieces, "id int, at long, piece string")
    want = whole(spark, texts)
    got = lt.counts(df, "id").select(*want.columns)
    assert {x.id: x.asDict() for x in got.collect()} == {x.id: x.asDict() for x in want.collect()}


def test_odd_pieces(spark):
    rows = [(None, 0, "1 +"), (None, 1, " 2 = 3"), (5, 0, None), (6, 3, "a")]
    got = {x.id: x for x in lt.counts(spark.createDataFrame(rows, "id int, at long, piece string"), "id").collect()}
    assert got[None].addition == 1 and got[None].equation == 1 and got[None].numbers == 3 and got[5].words == 0 and got[5].sentences == 1 and got[6].variable == 0
    assert lt.counts(spark.createDataFrame([], "id int, at long, piece string"), "id").count() == 0


def test_a_large_file_over_many_tasks(spark, tmp_path):
    """A file without line ends, read in ranges that cut characters, words, numbers and equations."""
    line = "Solve 3x + 4 = 19, é = 東京 or 1/2 of 10.5%; f(x) > 2 and a^2 ≤ b! "
    text = "".join(line.replace("19", str(k)) for k in range(60_000))
    (tmp_path / "large.txt").write_text(text, encoding="utf-8")
    named = spark.createDataFrame([(str(tmp_path / "large.txt"),), (str(tmp_path / "none.txt"),)], "path string")
    pieces = lt.read_pieces(named, size=200_003)
    held = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
    assert pieces.agg(F.sum(F.length("piece"))).first()[0] == len(text) and pieces.count() > 20 and max(held) < 6
    got = lt.counts(pieces, "path").drop("path").first().asDict()
    assert got == whole(spark, [(1, text)]).drop("id").first().asDict() and got["equation"] > 50_000


@pytest.mark.parametrize("size", [1, 2, 5])
def test_characters_beyond_the_basic_plane(spark, size):
    """They are one character each, also where a piece is cut."""
    texts = [(1, "😀😀 abc 𝑥𝑥𝑥 def."), (2, "𝟏𝟐 + 𝟑𝟒 = 𝟒𝟔, 𝑥^𝑦 < 𝟑 𝑓(𝑥) f(𝑥)! 𝐚𝐛𝐜 ok? 𝟑.𝟓%"), (3, "𐐀" * 9 + ". " + "𝟗" * 9 + "+1"), (4, "😀" * 20), (5, "≤𝑥≥ <= 𝟑 > 2 = 𝟒" * 3)]
    df = spark.createDataFrame([(k, at, t[s : s + size]) for k, t in texts for at, s in enumerate(range(0, len(t), size))], "id int, at int, piece string")
    want = whole(spark, texts)
    got = lt.counts(df, "id").select(*want.columns)
    assert {x.id: x.asDict() for x in got.collect()} == {x.id: x.asDict() for x in want.collect()}


def test_many_pieces_of_a_text(spark):
    """More than are joined at once, with gaps and negative places; places that are not whole numbers keep their order."""
    text = "".join(f"{k} + {k}.5 = x^{k % 7}, f(y{k}) < 3/4! " + ("unbroken" * 40 if k % 9 == 0 else "") for k in range(60))
    cut = [text[s : s + 2] for s in range(0, len(text), 2)]
    assert len(cut) > 4 * lt.BLOCK * lt.BLOCKS
    rows = [(1, 7 * at - 2000, t) for at, t in enumerate(cut)]
    want = whole(spark, [(1, text)]).drop("id").first().asDict()
    df = spark.createDataFrame(rows, "id int, at long, piece string").repartition(5)
    for at in (F.col("at"), F.format_string("%08d", F.col("at") + 2000), F.col("at") / 64):
        assert lt.counts(df.withColumn("at", at), "id").drop("id").first().asDict() == want


def test_texts_are_dealt_out_once(spark, sf_dir):
    """Pieces of a text are counted where they are read; only their rests meet. The query's texts move once, and nothing is joined."""
    from itemloom.plans.queries import QUERIES

    plan = QUERIES["counts_by_pieces"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("FileScan") + plan.count("BatchScan") == 1
    line = "Solve 3x + 4 = 19, or 1/2 of 10.5%; f(x) > 2 and a^2! " * 20
    pieces = spark.createDataFrame([(1, at, line) for at in range(64)], "id int, at long, piece string")
    parted = lt._parted(pieces.withColumnRenamed("piece", "__t"), ["id", "at"], dict.fromkeys(lt.ENDS, "__t"))
    rests = parted.agg(F.sum(sum(F.length(f"__rest_{n}") for n in lt.CUTS)).alias("n")).first().n
    assert rests < len(line) * 64 / 10
