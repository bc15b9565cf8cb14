"""Items and their images as streams."""

import datetime


from itemloom.operators.visual import FLAT_FEATURES
from itemloom.streaming import items as streams

IMAGES = "item_id long, ts timestamp, " + ", ".join(f"{n} double" for n in FLAT_FEATURES)
ITEMS = "item_id long, text string, ts timestamp"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


def test_items_joined_with_their_images(spark, tmp_path):
    """Files arrive one by one: images before and after their item, never, in another window, and too late."""
    files = [
        ("items", [(1, "Add 2 + 3.", at(0, 5)), (2, "No image", at(0, 10)), (3, "Images come later", at(0, 50)), (None, "no id", at(0, 20)), (1, "Again in another window", at(1, 5)), (7, "no time", None)]),
        ("images", [(1, at(0, 1), *[1.0] * 11), (1, at(0, 40), *[3.0] * 11), (9, at(0, 2), *[5.0] * 11), (None, at(0, 3), *[2.0] * 11)]),
        ("images", [(3, at(0, 55), *[4.0] * 11), (2, at(2, 1), *[7.0] * 11)]),
        ("items", [(4, "Later item", at(3, 0)), (5, "x", at(3, 30))]),
        ("images", [(4, at(3, 20), *[6.0] * 11)]),
        ("items", [(99, "closes", at(30))]),
        ("images", [(99, at(30), *[0.0] * 11)]),
        ("items", [(98, "closes", at(60))]),
        ("images", [(98, at(60), *[0.0] * 11)]),
    ]
    late = [("items", [(8, "too late", at(0, 6))]), ("images", [(2, at(0, 7), *[9.0] * 11)]), ("items", [(97, "closes", at(90))]), ("images", [(97, at(90), *[0.0] * 11)])]
    read = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    for n in ("items", "images"):
        (tmp_path / n).mkdir()
    joined = streams.item_features_stream(read("items", ITEMS), read("images", IMAGES))
    query = streams.write_features(joined, str(tmp_path / "out"), str(tmp_path / "check"), once=False)
    for name, rows in files + late:
        spark.createDataFrame(rows, ITEMS if name == "items" else IMAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        query.processAllAvailable()
    query.stop()
    rows_of = lambda name: [r for n, rows in files for r in rows if n == name]
    items, images = spark.createDataFrame(rows_of("items"), ITEMS), spark.createDataFrame(rows_of("images"), IMAGES)
    batch = streams.item_features_of_windows(items, images).where("item_id is null or item_id < 90")
    got = spark.read.parquet(str(tmp_path / "out")).where("item_id is null or item_id < 90")
    assert len(got.columns) == 48 and set(got.columns) == set(batch.columns)
    sorted_ = lambda df: sorted(map(repr, df.select(*sorted(batch.columns)).collect()))
    assert sorted_(got) == sorted_(batch)
    found = {(r.item_id, r.ts.hour): r.visual_line_count for r in got.collect()}
    assert found == {(1, 0): 4.0, (1, 1): None, (2, 0): None, (3, 0): 4.0, (None, 0): None, (4, 3): 6.0, (5, 3): None}
