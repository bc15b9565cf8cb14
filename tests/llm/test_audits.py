"""Whitening and the source divergence audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from itemloom.llm import divergence, whitening

# ---------------------------------------------------------------- whitening


def vectors(n, dims, seed=3):
    """Vectors of very different spreads around an offset, some repeated."""
    r = np.random.default_rng(seed)
    spread = 10.0 ** -np.linspace(0, 2.5, dims)
    turn = np.linalg.qr(r.normal(size=(dims, dims)))[0]
    found = (r.normal(size=(n, dims)) * spread * 40) @ turn + 5
    found[n // 2 : n // 2 + n // 3] = found[0]
    return found.astype(np.float32)


def plain_whitening(rows):
    """vec_id: (deviation, whitened rows) and explained, by the eigenvectors of the covariance."""
    xs = {i: np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(xs.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    d = (n * fit - s).astype(np.float64) / n
    cov = (d.astype(np.longdouble).T @ d.astype(np.longdouble) / n).astype(np.float64)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1].T
    return n, {i: (sum(int(q) ** 2 for q in n * x - s), ((n * x - s) / n) @ v[:16].T / np.sqrt(e[:16])) for i, x in xs.items()}, e[:16] / e.sum()


@pytest.mark.parametrize("dims,fan_in", [(20, 16), (7, 2)])
def test_whitening_against_eigenvectors(spark, monkeypatch, dims, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rows = list(enumerate(vectors(300, dims)))
    odd = [(900, None), (901, [1.0] * (dims - 1) + [None]), (902, [float("nan")] * dims), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in rows] + [(i, v, 2, None) for i, v in odd], "vec_id long, embedding array<float>, n int, x string").repartition(5)
    got = whitening.op11(df).collect()
    n, want, explained = plain_whitening(rows)
    k = min(16, dims)
    assert len(got) == 300 * k and {x.n for x in got} == {n} and len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    sign = {}
    for x in sorted(got, key=lambda x: (x.vec_id, x.component)):
        deviation, z = want[x.vec_id]
        assert x.deviation == deviation and abs(x.explained / explained[x.component - 1] - 1) < 1e-9
        s = sign.setdefault(x.component, 1 if x.whitened * z[x.component - 1] >= 0 else -1)
        assert abs(x.whitened - s * z[x.component - 1]) < 1e-6


def test_whitening_of_few_and_flat_vectors(spark):
    flat = [(k, [float(k % 5), 2.0, 2.0 * (k % 5), float(k % 3)]) for k in range(40)] + [(None, [1.0, 2.0, 2.0, 1.0])]
    got = whitening.op11(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {x.component for x in got} == {1, 2} and len(got) == 82 and {x.n for x in got} == {15} and got[0].identity_error < 1e-12
    assert sum(x.vec_id is None for x in got) == 2
    for rows in ([], [(1, [3.0, 4.0])], [(1, [3.0, 4.0]), (2, [3.0, 4.0])], [(1, None)], [(1, [])]):
        assert whitening.op11(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_jacobi_keeps_small_deviations():
    """Columns of sizes 1 to 1e-12: each singular value to full precision, where a covariance would have lost them."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(40, 9)))[0]
    sizes = 10.0 ** -np.arange(0, 18, 2)
    sigma, v = whitening.jacobi(whitening.triangle(q * sizes))
    assert np.abs(sigma / sizes - 1).max() < 1e-12
    assert np.abs(np.abs(v) - np.eye(9)).max() < 1e-9
    assert np.abs(v @ v.T - np.eye(9)).max() < 1e-13


def test_centring_is_exact_beyond_longs():
    x = np.array([[1 << 60, 3], [-(1 << 60), 5]])
    d = whitening.centred(x, 1000, np.array([7 << 60, 8], object))
    assert d.tolist() == [[(1000 << 60) - (7 << 60), 2992], [-(1000 << 60) - (7 << 60), 4992]]
    with pytest.raises(OverflowError):
        whitening.deviations(d)
    near = np.array([[3_000_000_000, 200_000_000]])
    assert whitening.deviations(near).tolist() == [3_000_000_000**2 + 200_000_000**2]


# ---------------------------------------------------------------- divergence


def plain_audit(rows, min_docs=10, top=10):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
        groups.add((lang, source))
        found[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(found[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, entries, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(entries, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("seed,min_docs", [(1, 2), (2, 1), (3, 10)])
def test_audit_against_brute_force(spark, monkeypatch, seed, min_docs):
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "PIECE", 30)
    r = random.Random(seed)
    words = ["Alpha", "alpha", "be-ta", "don't", "é", "Éa", "straße", "東京", "\U0001f600x", "x1y", "_", "9", "\x7fq", "long" * 20] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(0, 60))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None, "z"])) for _ in range(120)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("..", "fr", None), (None, None, None), rows[0], rows[0], ("once only", "it", "a")]
    df = spark.createDataFrame([(k, *x, 1, 2) for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term int, p int").repartition(4)
    got = sorted(map(tuple, divergence.audit(df, min_docs=min_docs).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_audit(rows, min_docs)
    assert divergence.op13(df.where("false")).count() == 0


def test_audit_against_sql(spark):
    import duckdb

    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["to", "Be", "or", "not", "été", "que"]) for _ in range(r.randrange(12))), r.choice("xy"), r.choice(["s", "t", None])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    c = duckdb.connect()
    c.register("documents", df.toArrow())
    want = c.sql(divergence.op13_sql()).fetchall()
    assert sorted(map(tuple, divergence.op13(df).collect())) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("bits,width", [(16, 2), (3, 1)])
def test_radix_top(spark, monkeypatch, bits, width):
    """Groups of few rows, of many equal values, and of equal values under long common prefixes."""
    monkeypatch.setattr(divergence, "BITS", bits)
    monkeypatch.setattr(divergence, "BYTES", width)
    monkeypatch.setattr(divergence, "SLOW", 3)
    r = random.Random(7)
    rows = [("few", k, f"i{k}") for k in range(4)] + [("ties", 5, f"t{k:03}") for k in range(80)] + [("zero", 0, f"{k}") for k in range(30)]
    rows += [("prefix", 9, "p" * 50 + "é" * (k % 7) + str(k)) for k in range(40)] + [("prefix", 10, "p"), ("prefix", 1 << 40, "q")]
    rows += [("many", r.randrange(1 << 34), f"m{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "g string, value long, item string")
    for k in (1, 10):
        want = sorted((g, v, i, n + 1) for name in {x[0] for x in rows} for n, (g, v, i) in enumerate(sorted((x for x in rows if x[0] == name), key=lambda x: (-x[1], x[2].encode()))[:k]))
        assert sorted(map(tuple, divergence.radix_top(df, ["g"], "value", "item", k).collect())) == want
    assert divergence.radix_top(df.where("false"), ["g"], "value", "item", 3).count() == 0
