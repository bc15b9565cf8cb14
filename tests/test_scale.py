"""What keeps the work of a row small, with the same counts."""

import re

import numpy as np
import pytest

from itemloom.functions import mathcontent
from itemloom.functions.readability import with_syllables, with_word_tables
from itemloom.operators import visual
from itemloom.plans.item import text_features

ODD = ["", "plain words only", "1 + 2", "1 - 2 − 3", "3×4*5·6", "7÷8/9", "a = b", "a < b > c ≤ d ≥ e", "x^2 y**3", "f(x) (y)", "a + b - c", "\\frac{1}{2}", "1.5", "5% 6.%", "3:4", "2 × 10^5", "d/dx f'(x) \\frac{d}{dx}", "∫ \\int", "\\lim lim_x", "∑ \\sum", "√ π ∞ ≈ ≠", "٣ + ٤ and ٣.٥", "é $1$ \\alpha"]


@pytest.mark.parametrize("name", list(mathcontent.PATTERNS))
def test_signs_change_no_count(spark, name):
    rows = spark.createDataFrame([(t,) for t in [*ODD, *(a + " " + b for a in ODD for b in ODD[1:])]], "t string").withColumn("s", mathcontent.signs("t"))
    found = rows.select(mathcontent.pattern_count("t", name).alias("whole"), mathcontent.pattern_count("t", name, "s").alias("by_signs")).collect()
    assert [r.whole for r in found] == [r.by_signs for r in found] and any(r.whole for r in found)


def test_symbols_are_those_of_the_signs(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("s", mathcontent.signs("t"))
    for name in mathcontent.SYMBOLS:
        found = rows.select(mathcontent.symbol_count("t", name).alias("whole"), mathcontent.symbol_count("s", name).alias("short")).collect()
        assert [r.whole for r in found] == [r.short for r in found]


def test_wide_projection_is_compiled(spark):
    """In whole-stage code all counts are one method, which the JVM only interprets."""
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    try:
        plan = text_features(spark.range(3).selectExpr("id", "concat(id, ' + 1') as txt"), "txt")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    lines = [x for x in plan.splitlines() if "Project" in x and "AS __m_sym_pi" in x]
    assert lines and not any("*(" in x.split("Project")[0] for x in lines)


def _blocks(seed: int) -> np.ndarray:
    return np.repeat(np.repeat(np.random.default_rng(seed).integers(0, 256, (8, 8, 1), np.uint8), 8, 0), 8, 1).repeat(3, axis=2)


def test_pixel_statistics_compute_nothing_else(spark, monkeypatch):
    """Edges and shapes are not looked for where they are not asked for."""
    images = [(k, ("", 64, 64, 3, 16, _blocks(k).tobytes())) for k in range(3)] + [(3, ("", -1, -1, 3, 16, None))]
    df = spark.createDataFrame(images, "id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    whole = {r.id: r.visual for r in visual.image_features(df, "id").collect()}
    found = {r.id: r.visual for r in visual.image_features(df, "id", pixels_only=True).collect()}
    assert all(found[k][p] == whole[k][p] for k in found for p in ("dimensions", "pixel_statistics")) and found.keys() == whole.keys()
    assert all(found[k][p] is None for k in found for p in visual.PARTS[2:])
    assert found[3].dimensions is None


@pytest.mark.parametrize("size", [64, 200])
def test_lines_and_circles_keep_their_counts(size):
    """Bins that no line can fill and centres outside the image are left out; what is there is still found."""
    image = np.zeros((size, size), bool)
    image[size // 3, 2 : size - 2] = image[2 : size - 2, size // 2] = True
    assert visual.line_count(image) == (2 if size == 200 else 0)
    y, x = np.ogrid[:size, :size]
    disc = np.where((y - size // 2) ** 2 + (x - size // 2) ** 2 < (size // 4) ** 2, 220, 20).astype(np.uint8)
    assert visual.circle_count(disc) == 1


def test_word_tables_hold_no_group_of_text_and_word(spark):
    """Groups of (text, word) are nearly as many as words, so no aggregate holds them."""
    rows = spark.range(3).selectExpr("id", "concat(id, ' one two two') as txt")
    found = with_word_tables(rows, "id", "txt", easy=spark.range(1).selectExpr("'two' as word"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[__k#\d+L?, __w#", plan) and "Aggregate [__k#" in plan
    assert {r.unfamiliar for r in found.collect()} == {2}


def test_word_tables_send_nothing_to_the_driver(spark):
    """Rows for each text or each word can pass Spark's size check and still be too many for a small driver."""
    rows = spark.range(50).selectExpr("id", "concat(id, ' one two two word', id) as txt")
    easy = spark.range(5).selectExpr("concat('word', id) as word")
    said = easy.selectExpr("word", "3 as syllables")
    ran = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    got, plan = ran(with_word_tables(rows, "id", "txt", easy=easy, pronounced=said))
    assert "isFinalPlan=true" in plan and plan.count("SortMergeJoin") == 4 and "Broadcast" not in plan
    assert {r.id: r.unfamiliar for r in got} == {k: 4 if k < 5 else 5 for k in range(50)}
    ruled, plan = ran(with_syllables(rows, said, "id", "txt"))
    assert "isFinalPlan=true" in plan and "SortMergeJoin [id#" in plan
    assert {r.id: r.syllables for r in ruled} == {r.id: r.syllables for r in got}
