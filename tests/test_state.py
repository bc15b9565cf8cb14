"""State that adds up: histograms of pixels, contingency tables, features kept between runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.operators import agreement, pixels, visual
from itemloom.plans import changed
from itemloom.plans.item import text_features

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def test_histograms_equal_the_arrays(spark):
    """One, three and four channels, odd sizes, unreadable images; items of several images, one without a readable one."""
    r = np.random.default_rng(4)
    rows, arrays = [], {}
    for k, (h, w, c) in enumerate([(5, 7, 1), (8, 4, 3), (3, 3, 4), (1, 1, 1), (6, 5, 3), (9, 2, 1)]):
        x = r.integers(0, 256, (h, w, c)).astype(np.uint8) if k != 4 else np.full((h, w, c), 200, np.uint8)
        rows.append((k, k // 2 if k < 4 else None, ("m", h, w, c, 0, bytearray(x.tobytes()))))
        arrays[k] = x
    rows += [(10, 0, ("m", -1, -1, -1, 0, None)), (11, 7, ("m", 2, 2, 1, 0, bytearray(b"abc"))), (12, 7, None)]
    df = spark.createDataFrame(rows, f"id int, item int, image {IMAGE}").repartition(3)
    plain = lambda x: (np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, :3]).astype(float).mean(axis=2).reshape(-1)
    stats = lambda v: (len(v), v.mean(), v.std(), v.min(), v.max(), np.median(v), v.max() - v.min())
    names = ("pixels", "mean", "std", "min", "max", "median", "contrast")
    got = {x.id: x for x in pixels.pixel_statistics(df, "id").collect()}
    assert set(got) == {*range(6), 10, 11, 12} and all(got[k].width is None and got[k].mean is None for k in (10, 11, 12))
    want = {x.id: x.visual for x in visual.image_features(df, "id").collect()}
    for k, x in arrays.items():
        assert np.allclose([got[k][n] for n in names], stats(plain(x)), rtol=1e-12)
        assert (got[k].width, got[k].height, got[k].aspect_ratio) == (want[k].dimensions.width, want[k].dimensions.height, want[k].dimensions.aspect_ratio)
        assert np.allclose([got[k][n] for n in names[1:]], [want[k].pixel_statistics[n] for n in names[1:]], rtol=1e-12)
    by_item = {x.item: x for x in pixels.item_statistics(df, "item").collect()}
    assert set(by_item) == {0, 1, None, 7} and by_item[7].images == 0 and by_item[7].mean is None and by_item[0].images == 2
    for item, ks in ((0, (0, 1)), (1, (2, 3)), (None, (4, 5))):
        assert np.allclose([by_item[item][n] for n in names], stats(np.concatenate([plain(arrays[k]) for k in ks])), rtol=1e-12)
    halves = pixels.histograms(df.where("id < 2"), ["item"]).unionByName(pixels.histograms(df.where("id >= 2"), ["item"]))
    assert sorted(map(repr, pixels.merged(halves, ["item"]).collect())) == sorted(map(repr, pixels.histograms(df, ["item"]).collect()))
    plan = pixels.item_statistics(df, "item")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and pixels.pixel_statistics(df.where("false"), "id").count() == 0


def test_kappa_over_days(spark, tmp_path):
    """Ratings that arrive in files: kappa from the kept tables equals kappa of all of them, and a repeated batch counts once."""
    r = random.Random(6)
    rows = [(k, r.choice("abc"), r.choice(["a", "b", "c", None]), r.choice("xy")) for k in range(300)]
    days = spark.createDataFrame(rows, "id int, p string, q string, g string")
    for d in range(3):
        days.where(f"id % 3 = {d}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    agreement.keep_counts(stream(), "p", "q", out, check, ["g"]).awaitTermination(120)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    for by in (None, ["g"]):
        want = sorted(map(tuple, agreement.kappa(days, "p", "q", by).collect()))
        assert sorted(map(tuple, agreement.kappa_of_counts(agreement.kept_counts(spark, out, by), by).collect())) == want
    days.where("id < 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    agreement.keep_counts(stream(), "p", "q", out, check, ["g"]).awaitTermination(120)
    agreement.contingency(days.where("id < 50"), "p", "q", ["g"]).write.mode("overwrite").parquet(f"{out}/batch=3")  # run again
    more = days.unionByName(days.where("id < 50"))
    assert agreement.kappa_of_counts(agreement.kept_counts(spark, out)).first() == agreement.kappa(more, "p", "q").first()
    assert tuple(agreement.kappa_of_counts(agreement.contingency(days.where("false"), "p", "q")).first()) == (0.0, 0.0, 0)


@pytest.mark.parametrize("mode", ["estimate", "formula"])
def test_only_what_changed_is_computed(spark, tmp_path, mode):
    texts = [f"Solve {k}x + {k % 7} = {k % 11} for x." for k in range(400)]
    first = spark.createDataFrame([(k, texts[k], "kept") for k in range(400)] + [(900, None, "n"), (901, " ", "b"), (902, texts[0], "again")], "item_id int, text string, more string")
    second = first.withColumn("text", F.when(F.col("item_id") % 100 == 5, F.concat("text", F.lit(" Why?"))).otherwise(F.col("text")))
    folder = str(tmp_path / "store")
    rows = lambda: spark.read.parquet(folder).count()
    sorted_ = lambda df: sorted(map(repr, df.collect()))
    got = changed.text_features_kept(first, folder, mode=mode)
    want = text_features(first, mode=mode)
    assert got.columns == want.columns and sorted_(got) == sorted_(want) and rows() == 402
    assert changed.missing(second, folder, mode=mode).count() == 4
    assert sorted_(changed.text_features_kept(second, folder, mode=mode)) == sorted_(text_features(second, mode=mode)) and rows() == 406
    changed.text_features_kept(second, folder, mode=mode)
    assert rows() == 406 and sorted_(got) == sorted_(want)
    assert changed.missing(first, folder, mode="estimate" if mode == "formula" else "formula").count() == 402
    assert changed.text_features_kept(first.where("false"), str(tmp_path / "none")).count() == 0


def test_word_tables_in_the_item_row(spark):
    """Easy words and a pronouncing table of 50,000 rows: the row's columns equal those by a list and by with_syllables."""
    from itemloom.functions import readability as rd
    from itemloom.plans.item import item_features

    rows = [(1, "The area, area! is equal (to) 4 x 3. Where is it?"), (2, "No listed words: here"), (3, None), (4, " "), (5, "THE THE the"), (None, "the area")]
    df = spark.createDataFrame(rows, "item_id int, text string")
    easy = ["The", "is", "to", "it", "where", "area"]
    table = spark.createDataFrame([(w,) for w in [*easy, "is", None, *(f"word{k}" for k in range(50_000))]], "word string")
    said = spark.createDataFrame([("area,", 7), ("AREA,", 9), ("the", 2), (None, 5), ("gone", None), *((f"word{k}", 3) for k in range(50_000))], "word string, syllables int")
    both = rd.with_word_tables(df, "item_id", easy=table, pronounced=said)
    assert {r.item_id: r.unfamiliar for r in both.collect()} == {1: 4, 2: 4, 3: None, 4: 0, 5: 0, None: None}
    want = {r.item_id: r.syllables for r in rd.with_syllables(df, said, "item_id").collect()}
    assert {r.item_id: r.syllables for r in both.collect()} == want | {4: 0}
    got = text_features(both, mode="formula", syllables="syllables", unfamiliar="unfamiliar")
    assert got.columns == text_features(df, mode="formula").columns and len(got.columns) == 35
    plain = {r.item_id: r for r in rd.with_readability(rd.with_syllables(df, said, "item_id"), "text", mode="formula", easy_words=easy, syllables="syllables").collect()}
    for r in got.where("item_id is not null").collect():
        assert r.readability_dale_chall == pytest.approx(plain[r.item_id].r_dale_chall_readability) and r.readability_flesch_kincaid_grade == pytest.approx(plain[r.item_id].r_flesch_kincaid_grade)
    assert rd.with_word_tables(df, "item_id").columns == df.columns
    assert len(item_features(both, mode="formula", syllables="syllables", unfamiliar="unfamiliar").columns) == 46
