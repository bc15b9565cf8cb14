"""Hand-derived values of the text operators."""

import pytest
from pyspark.sql import functions as F

from itemloom.functions import cognitive, extract, mathcontent, readability
from itemloom.operators.agreement import kappa_of
from itemloom.plans.item import collapse, item_features, text_features

T1 = "Dwayne is D years old. Dwayne sister is 3 years younger than Dwayne. Which expression represents Dwayne sister age in years? A) D+3 B) D-3 C) D*3 D) D/3"
T2 = "Divide. 228 / 4 ="
T4 = "Solve 2x + 5 = 15 for x"


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("5-3", [5, -3]), ("3.", [3.0]), ("−4", [4]), (T1, [3, 3, -3, 3, 3]), (T2, [228, 4]), (T4, [2, 5, 15]), ("", []), ("٣ + ٤.٥", [3, 4.5]), ("1" * 400, [float("inf")])])
def test_numbers(spark, text, want):
    assert value(spark, text, extract.numbers("t")) == want


@pytest.mark.parametrize("text,want", [("I have a cat, Dwayne's x", ["s", "x"]), ("d été t x² q", ["d", "q", "t"]), (T1, ["A", "B", "C", "D"]), (T4, ["x"]), ("", [])])
def test_variables(spark, text, want):
    assert value(spark, text, extract.variables("t")) == want


@pytest.mark.parametrize("word,want", [("make", 1), ("the", 1), ("by", 1), ("queue", 1), ("228", 1), ("", 0), ("divide.", 3), ("area", 2), ("triangle", 1)])
def test_syllables(spark, word, want):
    assert value(spark, word, extract.syllables_of_word("t")) == want
    assert value(spark, f"{word}  {word}", extract.syllables("t")) == 2 * want


@pytest.mark.parametrize(
    "name,text,want",
    [("equation", "a==b", 0), ("equation", "a=b=c=d", 2), ("equation", "=b", 0), ("inequality", "a<=b", 0), ("inequality", "a≤b≤c", 1), ("inequality", "a<b>c", 1), ("fraction", "1/2/3", 1), ("function", "f(x)g(y)", 2), ("exponent", "x^2 + y**{n}", 2), ("ratio", "at 10:30", 1), ("limit", r"\lim lim_x", 2), ("derivative", "f'(x) d/dx", 2), ("summation", r"∑ \sum", 2), ("percentage", "5% 2.5%", 2), ("scientific_notation", "3 × 10^5", 1), ("polynomial", "well-known", 1)],
)
def test_patterns(spark, name, text, want):
    assert value(spark, text, mathcontent.pattern_count("t", name)) == want


@pytest.mark.parametrize("text,want", [("well-known A) 5", "well known 5"), (r"\limits", "MATH its"), (T2, "Divide. 228 4"), (T4, "Solve 2x 5 15 for x"), ("$x$ is", "MATH is"), ("a \x1c  b ", "a b")])
def test_normalize(spark, text, want):
    assert value(spark, text, extract.normalize_math_text("t")) == want


def test_expressions_choices_lines(spark):
    assert value(spark, "$x$ and y = 2", extract.math_expressions("t")) == ["$x$", "y = 2"]
    assert value(spark, "A) 1 B) 2", extract.answer_choices("t")) == {"A": "1", "B": "2"}
    assert value(spark, "A) 1 A) 2", extract.answer_choices("t")) == {"A": "2"}
    assert value(spark, "  first \nsecond\n", extract.first_line("t")) == "first "
    assert value(spark, "```json\n{\"a\": {}}\n``` x", extract.json_slice("t")) == '{"a": {}}'
    assert value(spark, "no", extract.json_slice("t")) is None
    assert value(spark, "k sk-" + "a" * 24, extract.redact_secrets("t")) == "k ***"


@pytest.mark.parametrize("text,words,sentences", [(T1, 29, 4), (T2, 5, 2), (T4, 8, 1), ("3.5", 1, 2), ("", 0, 1), ("a\x1cb\x85c d　e", 5, 1)])
def test_word_and_sentence_counts(spark, text, words, sentences):
    assert value(spark, text, extract.word_count("t")) == words and value(spark, text, extract.sentence_count("t")) == sentences


def analysed(spark, text):
    return mathcontent.math_analysis(spark.createDataFrame([(text,)], "text string")).first()["math"]


def test_math_analysis(spark):
    m = analysed(spark, T1)
    assert m.pattern_matches == {"variable": 9} and m.vocabulary.math_terms == ["expression"] and m.math_density == pytest.approx(9 / 29)
    assert m.domain_classification.primary == "algebra" and m.domain_classification.confidence == 1 and m.domain_classification.secondary == ["arithmetic", "geometry"]
    assert m.symbol_counts == {"addition": 1, "subtraction": 1, "multiplication": 1, "division": 1} and m.numbers.range == 6 and m.numbers.has_negative and not m.numbers.has_decimal
    m = analysed(spark, T2)
    assert m.pattern_matches == {"division": 1} and m.math_density == 0.2 and m.domain_classification.primary == "arithmetic" and m.numbers.range == 224
    m = analysed(spark, "common denominator factor")
    assert m.vocabulary.math_terms == ["common denominator", "denominator", "factor"] and m.domain_classification.scores["fractions"] == 2
    m = analysed(spark, "factor")
    assert m.domain_classification.primary == "arithmetic" and m.domain_classification.confidence == 0.5
    assert analysed(spark, "points").vocabulary.math_terms == []
    for blank in ("", " \n ", None):
        m = analysed(spark, blank)
        assert m.domain_classification.primary == "unknown" and m.domain_classification.secondary == [] and m.math_density == 0 and m.pattern_matches == {}
    assert not analysed(spark, "9" * 400).numbers.has_decimal


def test_row_path_equals_corpus_path(spark, sf_dir):
    from itemloom.plans.queries import items

    df = items(spark, sf_dir)
    by_join = {(r.item_id, r.term): r.n for r in mathcontent.vocabulary_matches(df, "item_id", "txt").collect()}
    rows = mathcontent.math_analysis(df, "txt").select("item_id", "math.vocabulary.math_terms").collect()
    assert {(r.item_id, t) for r in rows for t in r.math_terms} == set(by_join)


def test_readability(spark):
    r = readability.readability(spark.createDataFrame([(T2,)], "text string")).first()["readability"]
    assert r.flesch_kincaid_grade == pytest.approx(2.95) and r.flesch_reading_ease == pytest.approx(64.3125) and r.gunning_fog == pytest.approx(3.245) and r.smog_index == pytest.approx(2.655)
    assert r.low_confidence and r.estimated
    r = readability.readability(spark.createDataFrame([(" ",)], "text string")).first()["readability"]
    assert r.flesch_reading_ease == 50 and r.smog_index == 8 and r.low_confidence and not r.estimated
    f = readability.readability(spark.createDataFrame([("The cat sat. The dog ran away quickly.",)], "text string"), mode="formula", easy_words=["the", "cat", "sat", "dog", "ran", "away"]).first()["readability"]
    assert f.flesch_kincaid_grade == pytest.approx(0.39 * 4 + 11.8 * 9 / 8 - 15.59) and f.dale_chall_readability == pytest.approx(0.1579 * 12.5 + 0.0496 * 4 + 3.6365)
    with pytest.raises(ValueError):
        readability.readability(spark.createDataFrame([("x",)], "text string"), mode="other")


def test_syllables_by_a_table(spark):
    table = spark.createDataFrame([("area", 3), ("AREA", 4), ("equal", 2), ("gone", None)], "word string, syllables int")
    rows = [(1, "The area area is equal"), (2, "no listed words here"), (3, None), (4, ""), (5, "gone area.")]
    df = readability.with_syllables(spark.createDataFrame(rows, "id int, text string"), table, "id")
    assert {r.id: r.syllables for r in df.collect()} == {1: 1 + 3 + 3 + 1 + 2, 2: 1 + 2 + 1 + 1, 3: None, 4: None, 5: 1 + 2}
    got = {r.id: r.r for r in readability.readability(df, to="r", syllables="syllables").collect()}
    assert got[1].flesch_reading_ease == pytest.approx(206.835 - 1.015 * 5 - 84.6 * 10 / 5) and got[2].flesch_reading_ease == pytest.approx(206.835 - 1.015 * 4 - 84.6 * 5 / 4) and got[3].flesch_reading_ease == 50


def test_cognitive_load(spark):
    df = spark.createDataFrame([(T1, ["expression"]), (T2, None), ("", None), ("solve and Solve the area", [])], "text string, terms array<string>")
    a, b, c, d = (r["cognitive"] for r in cognitive.cognitive_load(df, terms="terms").collect())
    assert (a.numeric_elements, a.variable_count, a.operation_count, a.word_count, a.sentence_count, a.math_term_count) == (5, 4, 4, 29, 4, 1) and a.element_density == pytest.approx(9 / 29) and a.avg_sentence_length == 7.25
    assert (b.operation_count, b.element_density, b.math_term_count) == (2, 0.4, 1)
    assert tuple(c) == (0, 0, 0, 0, 0, 0, 0.0, 0.0) and d.math_term_count == 2


def test_item_row(spark):
    items = spark.createDataFrame([(1, T1), (2, T2), (3, None)], "item_id long, text string")
    rows = {r.item_id: r for r in item_features(items).collect()}
    assert len(rows[1].asDict()) == 46 and rows[1].visual_width is None
    assert rows[2].math_domain_primary == "arithmetic" and rows[2].cognitive_math_term_count == 1 and rows[2].readability_low_confidence == 1
    assert rows[3].math_domain_primary == "unknown" and rows[3].cognitive_word_count == 0 and rows[3].readability_flesch_reading_ease == 50
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None), (1, 10, "c")], "item_id long, seq int, text string")
    assert {r.item_id: r.text for r in collapse(parts, "item_id", "seq").collect()} == {1: "a b c", 2: ""}


def test_numbers_are_extracted_once(spark, sf_dir):
    from itemloom.plans.queries import items

    plan = text_features(items(spark, sf_dir), "txt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("-?" + chr(92) + "p{Nd}+" + chr(92) + ".?" + chr(92) + "p{Nd}*, 0") == 1 and "Exchange" not in text_features(spark.range(3).selectExpr("id", "'x' as txt"), "txt")._jdf.queryExecution().executedPlan().toString()


def test_long_texts_stay_linear(spark):
    import time

    df = spark.createDataFrame([("x " * 200_000,), ("x" * 400_000,), ("=" * 100_000,), (" " * 300_000,), ("1" * 100_000,)], "text string")
    start = time.time()
    df.select(*[mathcontent.pattern_count("text", n) for n in mathcontent.PATTERNS], extract.sentence_count("text"), extract.syllables("text")).collect()
    assert time.time() - start < 60


@pytest.mark.parametrize("a,b,want", [([1, 2, 3, 1], [1, 2, 1, 1], (0.75, 0.5556, 4)), ([1, 1], [1, 1], (1.0, 0.0, 2)), ([], [], (0.0, 0.0, 0))])
def test_kappa(spark, a, b, want):
    r = kappa_of(a, b, spark)
    assert (r["agreement"], r["kappa"], r["n"]) == want


def test_kappa_needs_pairs(spark):
    with pytest.raises(ValueError):
        kappa_of([1], [], spark)


def test_null_and_odd_rows_do_not_crash(spark):
    df = spark.createDataFrame([(None,), ("",), ("😀" * 50,), ("\x00퟿",)], "text string")
    assert text_features(df.select(F.monotonically_increasing_id().alias("id"), "text")).count() == 4
    assert len(text_features(df).collect()) == 4
    clash = text_features(df.select("text", F.lit("own").alias("Math_Density"), F.lit(1).alias("id")))
    assert clash.columns[0] == "id" and len(clash.columns) == 35 and clash.select("math_density").dtypes[0][1] == "double"
