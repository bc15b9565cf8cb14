"""The adaptive prefix join against brute force."""

import random

import numpy as np
import pytest

from itemloom.llm import ngramjoin as nj

from .cases import documents, prose, texts


def plain(rows):
    """doc_id, n_shingles, component_id, from sets of strings."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in nj.re.split("[\x20\x09-\x0d]+", w) if x]
        sets.append({" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def edited(r, words, n):
    words = list(words)
    for p in r.sample(range(len(words)), n):
        words[p] = f"e{r.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Odd texts, pairs on both sides of the threshold, tight and loose groups, a chain, a passage and a line that many share."""
    r = random.Random(seed)
    rows = [*texts(), (16, "one two three"), (17, "One two THREE"), (18, "one two"), (19, "a b c d"), (20, "A b c d"), (21, "a b c d e")]
    for k in range(40):
        words = prose(100 + k, 60 + 7 * k).split()
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, edited(r, words, k % 5))]
    base = prose(300, 160).split()
    rows += [(2000 + k, edited(r, base, r.randrange(0, 3))) for k in range(70)]
    base = prose(301, 200).split()
    rows += [(3000 + k, edited(r, base, r.randrange(2, 9))) for k in range(60)]
    chain = prose(302, 240).split()
    for k in range(14):
        chain[11 + 16 * k] = f"c{k}"
        rows.append((4000 + k, " ".join(chain)))
    passage = prose(303, 60)
    rows += [(5000 + k, prose(400 + k, 4 + k % 30) + " " + passage) for k in range(60)]
    rows += [(6000 + k, " ".join(prose(500 + k, 60).split()[: 40 + k])) for k in range(12) for _ in range(1 + k % 2)]
    base = prose(304, 100)
    rows += [(7000 + k, base + " " + prose(600, k)) for k in range(25)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,changes", [(1, {}), (2, {"WIDE": 20, "STAR": 3, "WIDTH": 256, "RANGE": 64, "FAN_IN": 2, "HOT": 2}), (3, {"WAVES": 0, "LEVELS": 3, "PIECE": 50})])
def test_join_equals_brute_force(spark, monkeypatch, seed, changes):
    for k, v in changes.items():
        monkeypatch.setattr(nj, k, v)
    rows = corpus(seed)
    got = sorted(map(tuple, nj.op12(documents(spark, rows)).collect()), key=repr)
    want = plain(rows)
    assert got == want
    assert 20 < len(want) - len({c for _, _, c in want})


def test_join_of_empty_tables(spark):
    assert nj.op12(documents(spark, [])).count() == 0
    got = nj.op12(documents(spark, [(1, None), (2, ""), (None, " \n")])).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 0, 1), (2, 0, 2), (None, 0, None)]))


def test_prefixes_of_linked_sets_share_as_many_as_their_level():
    """Whatever the order of shingles and the levels, of two linked sets the smaller one's level is met."""
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 90))
        a = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.08], r.integers(0, 1 << 60, int(r.integers(0, 8)), dtype=np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        rank_of = r.integers(0, 6, 64).astype(np.uint8)
        small, large = sorted((a, b), key=len)
        _, own, _ = nj.prefix(small, rank_of)
        at = lambda h: nj.prefix(h, rank_of)[0][: len(h) - nj.least_overlap(len(h)) + own]  # noqa: B023, E731
        assert len(np.intersect1d(at(small), at(large))) >= own


def test_levels_follow_the_estimated_cost():
    assert nj.level(1000, np.zeros(200, np.uint8)) == 1  # nothing in common with anyone
    assert nj.level(1000, np.full(158, 6, np.uint8)) == 8  # comparisons of long sets are saved
    rising = np.concatenate([np.full(151, 1), [12] * 7]).astype(np.uint8)
    assert nj.level(1000, rising) == 1  # the next shingles are very common
    assert nj.level(1, np.zeros(1, np.uint8)) == 1


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """400 near copies: some comparisons a set, not a square of them."""
    r, base, tried = random.Random(11), prose(800, 150).split(), []
    rows = [(k, edited(r, base, r.randrange(0, 3))) for k in range(400)]
    whole = nj.verified

    def counted(pairs, sets):
        tried.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(nj, "verified", counted)
    got = nj.op12(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert sum(tried) < 8 * len(rows)


@pytest.mark.parametrize("own", [15, 9])
def test_shingles_behind_a_partners_prefix_are_still_shared(spark, own):
    """A set whose prefix begins with rare shingles of its own indexes few of those that it shares; the other one meets nobody at the rest."""
    words = [f"w{k}" for k in range(103)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"r{k}" for k in range(own)])), (3, prose(40, 90))]
    assert sorted(map(tuple, nj.op12(documents(spark, rows)).collect())) == plain(rows) == [(1, 100, 1), (2, 100 + own, 1), (3, 87, 3)]


def test_signatures_bound_what_sets_share():
    r = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.3], r.integers(0, 1 << 63, int(r.integers(1, 40)), dtype=np.uint64)]))
        differ = int(np.bitwise_count((nj.signature(a) ^ nj.signature(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert (len(np.setxor1d(a, b)) - differ) % 2 == 0


def test_near_texts_that_do_not_link_make_no_pairs(spark, monkeypatch):
    """300 texts near one text, but not each other: hardly any pair is made, where all but a few met before."""
    r, base, made = random.Random(12), prose(801, 150).split(), []
    rows = [(k, edited(r, base, r.randrange(2, 12))) for k in range(300)]
    whole = nj.map_arrow

    def counted(df, f, schema):
        out = whole(df, f, schema)
        if schema == nj._PAIRS:
            made.append(out.count())
        return out

    monkeypatch.setattr(nj, "map_arrow", counted)
    got = nj.op12(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    assert sum(made) < len(rows)
