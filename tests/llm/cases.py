"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing further columns."""

import random

WORDS = "the of and to in is that it was for on are as with his they be at one have this from or had by word but what all were we when your can said there use an each which she do how their if".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def texts() -> list[tuple]:
    """doc_id, text."""
    passage = prose(99, 70)
    base = prose(1, 200)
    near = base.split()
    near[100] = "changed"
    rows = [
        (0, base),
        (1, base),  # a copy
        (2, " ".join(near)),  # a near copy
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "short text"),
        (7, prose(2, 60) + "\n" + passage + "\n" + prose(3, 60)),
        (8, prose(4, 90) + " " + passage + " " + prose(5, 20)),
        (9, passage),
        (10, "again and " * 200),
        (11, prose(6, 6000)),  # long
        (12, "été straße 東京 😀 ½ x² \x1c\x85\xa0end  two   spaces\n\n\nlines don't it's WE'LL"),
        (13, "line one\nline one\nline two\nline one"),
        (None, "no id " + prose(7, 80)),
        (14, prose(8, 120)),
        (14, prose(8, 120)),  # a repeated row
        (15, prose(9, 50)),
        (15, prose(10, 55)),  # one id, two texts
    ]
    return rows


def documents(spark, rows=None):
    """With further columns whose names clash with those that operators use inside."""
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "src", None if t is None else len(t), 7, "x", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string, label int").repartition(3)


def collected(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)
