"""Source divergence audit: how the term shares of each source of a language differ from the other sources' and from the language's.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lowered. A task tallies whole texts by (language, source, term):
occurrences and documents. Each language keeps the terms of MIN_DOCS or more of its documents. A group's smoothed share p of a
kept term is 1 + floor(SCALE * (count + 2) / (N + 2 V)), in whole numbers.

Pairs of sources are sparse: a term that neither source has adds the same amount f(base, base) to their divergence, so a pair
starts from V times that; each source corrects it once for each different share that it holds (a histogram, not its terms), and
only terms that both hold meet in a join.

The terms that a group holds more of than its language are ranked by radix selection: histograms over BITS bits of the value,
highest first, find the bucket in which a group's kth value lies, until its threshold is known; groups whose threshold has more
ties than places left go on by histograms over the terms' UTF-8 bytes. Only chosen rows, k to a group, are sorted.

Defined results: null text, language and source are empty strings; a group without kept terms has N = 0 and still takes part in
pairs; a language without kept terms has pairs of value 0 and no terms; repeated rows count as often as they occur; ties go by
UTF-8 bytes; texts are read whole, in pieces that end between terms; an empty table gives no rows; further columns are ignored.
Sums beyond a long are an error.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Bits of a value, and bytes of a term, that one histogram tells apart. After SLOW rounds of bytes their number doubles.
BITS, BYTES, SLOW = 16, 2, 8
#: Terms that a task tallies before it passes them on, and bytes of a text that it splits at once.
HELD, PIECE = 1 << 19, 1 << 20

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Everything but a term's bytes becomes a space; A-Z become a-z. Bytes of one character beyond ASCII stay together.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))
_BREAK = re.compile(b"[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; no piece ends within a term."""
    start = 0
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = _BREAK.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[start:end].translate(_TABLE).split()
        start = end


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """lang, source, term, n, docs: what this task has counted, a batch for each group. A row without a term says that its group occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[dict]:
        for (lang, source), (counts, docs) in held.items():
            terms, rows = list(counts), len(counts) + 1
            yield {"lang": [lang] * rows, "source": [source] * rows, "term": [None, *terms], "n": [0, *counts.values()], "docs": [0, *map(docs.__getitem__, terms)]}

    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            counts, docs = held.setdefault(group, (Counter(), Counter()))
            before, own = len(counts), set()
            for part in pieces(text[k].as_py()):
                counts.update(part)
                own.update(part)
            docs.update(own)
            size += len(counts) - before
            if size >= HELD:
                yield from out()
                held, size = {}, 0
    yield from out()


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a row with a null term for each group."""
    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    tallied = map_arrow(plain, _tally, "lang string, source string, term binary, n long, docs long")
    return tallied.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, of: str, terms: str) -> Column:
    """p: 1 + floor(SCALE * (count + 2) / (of + 2 * terms))."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)) div cast({of} + 2 * {terms} as decimal(20,0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


# ---------------------------------------------------------------- radix selection


def _crossed(found: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Of each group's histogram (digit, size) the bucket in which its kth row lies; size: that bucket's rows, need: how many of them."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = found.withColumn("upto", F.sum("size").over(upto))
    return sums.where("upto >= need and upto - size < need").withColumn("need", F.expr("need - (upto - size)"))


def radix_top(rows: DataFrame, by: list[str], value: str, item: str, k: int) -> DataFrame:
    """The rows of the k largest values of each group, with their rank (int, from 1). Ties go to the least UTF-8 bytes of the item.

    rows: a written table; values are whole and not negative. Of each group a row of state travels between rounds: low, the
    threshold so far; edge, the bytes up to which ties are in; need, how many rows are still to be found in its bucket.
    """
    most = rows.agg(F.max(value)).first()[0]
    bits = max(1, (most or 0).bit_length())
    shift = -(-bits // BITS) * BITS
    state = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).select(*by, F.lit(0).cast("long").alias("low"), F.lit(k).cast("long").alias("need"), F.expr(f"size <= {k}").alias("done"), F.expr("cast('' as binary)").alias("edge"))
    state = materialize(state)

    def after(open_: DataFrame, low: Column, edge: Column, done: Column) -> DataFrame:
        new = open_.select(*by, low.alias("low"), "need", done.alias("done"), edge.alias("edge"))
        return materialize(state.where("done").unionByName(new), drop=state)

    while shift > 0 and not state.where("not done").isEmpty():
        at = rows.join(state.where("not done"), by).where(f"shiftright({value}, {shift}) = shiftright(low, {shift})")
        shift -= BITS
        found = at.groupBy(*by, "low", "need", "edge", F.expr(f"shiftright({value}, {shift}) & {(1 << BITS) - 1}").alias("digit")).agg(F.count(F.lit(1)).alias("size"))
        state = after(_crossed(found, by, F.desc("digit")), F.expr(f"low + shiftleft(digit, {shift})"), F.col("edge"), F.expr("size = need"))
    width, rounds = BYTES, 0
    while not state.where("not done").isEmpty():
        tied = rows.join(state.where("not done"), by).where(f"{value} = low and substring(cast({item} as binary), 1, length(edge)) = edge")
        digit = F.expr(f"substring(cast({item} as binary), length(edge) + 1, {width})")
        found = tied.groupBy(*by, "low", "need", "edge", digit.alias("digit")).agg(F.count(F.lit(1)).alias("size"))
        state = after(_crossed(found, by, F.asc("digit")), F.col("low"), F.expr("concat(edge, digit)"), F.expr(f"size = need or length(digit) < {width}"))
        rounds += 1
        width *= 1 + (rounds >= SLOW)
    chosen = rows.join(state.select(*by, "low", "edge"), by).where(f"{value} > low or {value} = low and substring(cast({item} as binary), 1, length(edge)) <= edge")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.asc(item)))
    return chosen.select(*rows.columns, rank.alias("rank")).where(F.col("rank") <= k)


# ---------------------------------------------------------------- the audit


def audit(documents: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = materialize(term_counts(documents))
    vocabulary = materialize(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))
    kept = materialize(counts.where("term is not null").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    groups = materialize(groups.withColumn("base", F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(0)))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "base")
    shares = materialize(shares)
    return _pairs(groups, shares).unionByName(_terms(shares, top))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))
    two = lambda value: [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), value.alias("value")]
    neither = groups.join(other, "lang").where("source < other").select("lang", *two(F.when(F.col("terms") > 0, F.col("terms") * gap("base", "other_base")).otherwise(0)))
    held = shares.groupBy("lang", "source", "base", "p").agg(F.count(F.lit(1)).alias("size"))
    one = held.join(other, "lang").where("source <> other").select("lang", *two(F.col("size") * (gap("p", "other_base") - gap("base", "other_base"))))
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("base").alias("other_base"))
    both = shares.join(right, ["lang", "term"]).where("source < other")
    both = both.select("lang", *two(gap("p", "other_p") - gap("p", "other_base") - gap("base", "other_p") + gap("base", "other_base")))
    pair = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    each = pair.select("lang", sides.alias("x"), "value").select("lang", "x.source", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return each.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    rows = materialize(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value")))
    return radix_top(rows, ["lang", "source"], "value", "item", top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op13(documents: DataFrame) -> DataFrame:
    return audit(documents)


def op13_sql() -> str:
    """The same, dense: each group with each term of its language."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = lambda n, total: f"1 + ({SCALE}::hugeint * ({n} + 2)) // ({total} + 2 * v)"
    f = "cast(((p - q) * (p - q)) // (p + q) as bigint)"
    return rf"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({lower}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
o as (select r, lang, source, unnest(w) as term from d),
vocab as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= {MIN_DOCS}),
c as (select o.lang, o.source, o.term, count(*) as n from o join vocab using (lang, term) group by all),
dense as (select g.lang, g.source, vocab.term, coalesce(c.n, 0) as n, vocab.n as ln from g join vocab using (lang) left join c using (lang, source, term)),
sums as (select *, sum(n) over (partition by lang, source) as total, sum(ln) over (partition by lang, source) as lt, count(*) over (partition by lang, source) as v from dense),
s as (select lang, source, term, n, {p('n', 'total')} as p, {p('ln', 'lt')} as q from sums),
pairs as (select a.lang, a.source, b.source as item, cast(sum(cast(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) as bigint)) as bigint) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
allpairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
x as (select lang, source, 'pair' as part, item, value from allpairs union all select lang, source, 'term', term, {f} from s where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from x)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}"""
