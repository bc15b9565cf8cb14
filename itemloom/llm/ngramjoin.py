"""Jaccard join on distinct WORDS-word shingles (LINK / OUT_OF or more) by adaptive multi-match prefixes.

Shingles have one order for all documents: rare ones first, by a sketch of how often the corpus holds them (WIDTH counts of hash
buckets; how good it is decides the work, never the result), then by hash. A set of n shingles shares at least o = ceil(0.85 n) with
any set that it links with, so of two linked sets the first n - o + m shingles of each (the prefixes of level m) share at least m.

Each set chooses its level where the estimated cost is least: a longer prefix reads more postings, but a partner must share as
many more of its shingles before the two sets are compared. A set's prefix of the highest level is indexed, each shingle with its
place. Of two sets that meet at a shingle the smaller one probes, at its own level, in the prefixes that the sizes of both ask for,
and the pair goes on if it meets that many times. Shingles at the head of a prefix at which a set meets nobody bound what it may share.

Each set also has SIGNATURE bits, the parity of its shingles on each. Bits that differ between two sets are at most as many as
shingles that they don't share, so what can't link is known without the sets. Only meetings of sets that may link are kept as
postings: neither chance meetings nor near texts that don't link reach the waves, where pairs are made.

Equal sets become one row first. A set that meets others at fewer shingles of its longest prefix than any link takes is left out
before sets are fetched. Large groups of near copies would still meet in all pairs, so labels are found in waves: in the
first ones each set is compared with a few of those that it meets with (wave by wave others, and more), what links shares a label,
and sets of one label need no comparison. The last wave is the whole join of what has different labels: no link is lost.

Common shingles stand in a prefix only where a document has nothing rarer. Those that are estimated to be very common are dealt
out by set as well as by shingle, and meetings of more than WIDE sets are searched in blocks, a task for each pair of blocks;
comparisons of one set with many are split STAR at a time. So no task holds a whole hot group.

Defined results: A-Z are lowered, words split at ASCII white space; a text of fewer than WORDS words has its whole sequence as its
one shingle; null texts and those without words have no shingles and are linked with nothing, not with each other; texts are read
whole, in pieces that end between words; equal texts and repeated rows share their component; null ids never name a component
(one whose ids are all null has a null id); rows of one id with different texts are apart; an empty table gives no rows; further
columns are ignored. Shingles are told apart by 64 bits of hash, sets by 128.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, dealt, map_arrow, materialize, pack, unpack
from .components import components

WORDS = 4
LINK, OUT_OF = 85, 100
#: Levels that a set may choose; what reading a posting costs, in shingles of a comparison.
LEVELS, POSTING = 8, 16
#: Counts of the sketch, those in one row of it, and how many tasks' counts are added at once.
WIDTH, RANGE, FAN_IN = 1 << 22, 1 << 16, 64
#: Hashes that a task counts at once.
HELD = 1 << 20
#: Shingles whose bucket holds so many times the mean are dealt out by set too (a power of two).
HOT = 16
WIDE, STAR = 4096, 256
#: Waves before the last, at most; they end when fewer than one comparison in FEW links.
WAVES, FEW = 4, 8
#: Bits of a signature, which is so many longs.
SIGNATURE = 256
SIGNS = tuple(f"s{k}" for k in range(SIGNATURE // 64))
PIECE = 1 << 20
_SPACE = re.compile(b"[ \t-\r]")
_ENTRY = np.dtype([("token", "<u8"), ("n", "<u4"), ("place", "<u4"), ("local", "<u2"), ("own", "u1")])
#: Sets that are dealt out at once.
SETS = 2048


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, sorted. A shingle's hash chains those of its words, from their number."""
    import xxhash

    digest, parts, start = xxhash.xxh64_intdigest, [], 0
    text = text or b""
    while start < len(text):
        end = start + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        parts.append(np.fromiter(map(digest, text[start:end].lower().split()), np.uint64))
        start = end
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    size = min(WORDS, len(words))
    if not size:
        return words
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed((h ^ words[k : k + len(h)]) + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h)


def least_overlap(n: int) -> int:
    """What a set of n shares with any set that it links with."""
    return -(-LINK * n // OUT_OF)


# ---------------------------------------------------------------- the sketch


def _places(h: np.ndarray, width: int) -> np.ndarray:
    return (h % np.uint64(width)).astype(np.int64)


def _tallies(batches: Iterator[pa.RecordBatch], hashes, width: int) -> Iterator[dict]:
    """This task's counts of hashes by place, a row for each range that has any."""
    from pyspark import TaskContext

    counts, held, size = np.zeros(width, np.uint32), [], 0

    def add() -> None:
        at, n = np.unique(_places(np.concatenate(held), width), return_counts=True)
        counts[at] += n.astype(np.uint32)

    for batch in batches:
        for h in hashes(batch):
            held.append(h)
            size += len(h)
            if size >= HELD:
                add()
                held, size = [], 0
    if held:
        add()
    span = min(RANGE, width)
    rows = [(s // span, at, counts[s : s + span][at]) for s in range(0, width, span) if len(at := np.flatnonzero(counts[s : s + span]))]
    part = TaskContext.get().partitionId()
    yield {"span": [r for r, _, _ in rows], "part": [part] * len(rows), "at": [pack(a.astype(np.uint16)) for _, a, _ in rows], "size": [pack(c.astype(np.uint64)) for _, _, c in rows]}


def _added(table: pa.Table) -> pa.Table:
    sizes = np.zeros(RANGE, np.uint64)
    for at, size in zip(table.column("at").to_pylist(), table.column("size").to_pylist(), strict=True):
        sizes[unpack(at, "<u2")] += unpack(size, "<u8")
    at = np.flatnonzero(sizes)
    return pa.table({"span": [table.column("span")[0].as_py()], "part": [table.column("part")[0].as_py() // FAN_IN], "at": [pack(at.astype(np.uint16))], "size": [pack(sizes[at])]})


def sketch(df: DataFrame, hashes, width: int) -> np.ndarray:
    """How many of all hashes fall on each of width places. hashes: arrays of a batch. Tasks' counts are added up a tree by ranges."""
    schema = "span long, part long, at binary, size binary"
    parts = materialize(map_arrow(df, lambda b: _tallies(b, hashes, width), schema))
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = materialize(parts.groupBy("span", F.expr(f"part div {FAN_IN}").alias("to")).applyInArrow(_added, schema), drop=parts)
        most //= FAN_IN
        if not most:
            break
    sizes = np.zeros(width, np.uint64)
    for row in parts.collect():  # width numbers, whatever the input
        sizes[row.span * RANGE + unpack(bytes(row.at), "<u2").astype(np.int64)] = unpack(bytes(row.size), "<u8")
    return sizes


def ranks(sizes: np.ndarray) -> np.ndarray:
    """How common the shingles of each place are: the binary logarithm of their number over the mean, a byte."""
    mean = max(1, int(sizes.sum()) // len(sizes))
    over = sizes // np.uint64(mean)
    return np.where(over > 0, np.log2(np.maximum(over, 1).astype(np.float64)), 0).astype(np.uint8)


# ---------------------------------------------------------------- sets and prefixes


def level(n: int, rank: np.ndarray) -> int:
    """The level of least cost. rank: of the prefix of the highest level, in order.

    Each posting is read; of the sets found there at most one in m shares m shingles, and is compared.
    """
    first = n - least_overlap(n)
    most = min(LEVELS, least_overlap(n))
    found = np.cumsum(2.0**rank - 1)[first : first + most]
    return int(np.argmin(found * (POSTING + n / np.arange(1, len(found) + 1)))) + 1


def prefix(h: np.ndarray, rank_of: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The prefix of the highest level in order, the chosen level, and how many of its shingles aren't very common."""
    n = len(h)
    rank = rank_of[_places(h, len(rank_of))]
    order = np.lexsort((h, rank))[: n - least_overlap(n) + LEVELS]
    rank = rank[order]
    return h[order], level(n, rank), int((rank < HOT.bit_length() - 1).sum())


def key_of(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes())


def signature(h: np.ndarray) -> np.ndarray:
    """Of each bit whether an odd number of the shingles falls on it, as longs."""
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    text = batch.column("text").cast(pa.binary())
    return (shingles(text[k].as_py()) for k in range(batch.num_rows))


def _prefixes(batches: Iterator[pa.RecordBatch], packed: bytes) -> Iterator[dict]:
    rank_of = unpack(packed, "u1")
    for batch in batches:
        rows = []
        for h in _hashes(batch):
            tokens, own, rare = prefix(h, rank_of) if len(h) else (h, 0, 0)
            rows.append((key_of(h), len(h), own, rare, tokens.tobytes(), *signature(h).tolist()))
        names = ("key", "n", "level", "rare", "tokens", *SIGNS)
        found = dict(zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True))
        yield {"doc_id": batch.column("doc_id"), "th": batch.column("th")} | found


def _entries(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[dict]:
    """Packed postings by bucket. Numbers of sets are base << 16 | local. Very common shingles go to a bucket by set too (own: level, high bit set)."""
    for batch in batches:
        for s in range(0, batch.num_rows, SETS):
            part = batch.slice(s, SETS)
            num, n, own, rare = (part.column(c).to_numpy() for c in ("num", "n", "level", "rare"))
            tokens = [np.frombuffer(x, "<u8") for x in part.column("tokens").to_pylist()]
            sizes = np.array([len(x) for x in tokens])
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            row = np.repeat(np.arange(len(num)), sizes)
            entries = np.empty(len(row), _ENTRY)
            entries["token"], entries["n"], entries["local"] = np.concatenate(tokens), n[row], num[row] & 0xFFFF
            entries["place"] = place
            hot = place >= rare[row]
            entries["own"] = own[row] | hot << 7
            to = (_mixed(entries["token"] + np.where(hot, num[row], 0).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            base = num[row] >> 16
            order = np.lexsort((to, base))
            to, base, entries = to[order], base[order], entries[order]
            edges = np.concatenate([[0], np.flatnonzero((to[1:] != to[:-1]) | (base[1:] != base[:-1])) + 1, [len(to)]]) if len(to) else np.zeros(1, int)
            yield {"bucket": to[edges[:-1]].astype(np.int32), "base": base[edges[:-1]], "rows": [entries[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]}


_MET = "token long, num long, n long, place long, own int"


def _met(table: pa.Table) -> pa.Table:
    """Of a bucket's postings those that may have a partner: a set at the same shingle whose size is near enough, or a very common shingle."""
    blobs = table.column("rows").to_pylist()
    entries = np.frombuffer(b"".join(blobs), _ENTRY)
    num = np.repeat(table.column("base").to_numpy(), [len(x) // _ENTRY.itemsize for x in blobs]) << 16 | entries["local"]
    order = np.lexsort((num, entries["n"], entries["token"]))
    entries, num = entries[order], num[order]
    n = entries["n"].astype(np.int64)
    near = (entries["token"][1:] == entries["token"][:-1]) & (LINK * n[1:] <= OUT_OF * n[:-1])
    kept = np.concatenate([near, [False]]) | np.concatenate([[False], near]) | (entries["own"] >> 7 > 0)
    entries = entries[kept]
    return pa.table({"token": entries["token"].view(np.int64), "num": num[kept], "n": n[kept], "place": entries["place"].astype(np.int64), "own": (entries["own"] & 0x7F).astype(np.int32)})


def _bounded(met: DataFrame) -> DataFrame:
    """num, most: the sets that may have a partner, and how many shingles each may share with anyone.

    Linked sets share LEVELS shingles of their longest prefixes (all that they share, if fewer), so a set that meets others at fewer
    has no partner. Where a set holds fewer than LEVELS shingles before one that it shares with a partner, that one is also in the
    partner's longest prefix; so of its shingles up to the LEVELS-th meeting those without a meeting are in no partner. Behind it
    a shingle without a meeting may still be shared: it may stand behind the partner's prefix.
    """
    least = F.ceil(F.col("n") * LINK / OUT_OF)
    whole = met.groupBy("num", "n").agg(F.sort_array(F.collect_set("place")).alias("at"))
    held = F.size("at").cast("long")
    alone = F.coalesce(F.get("at", F.lit(LEVELS - 1)) - (LEVELS - 1), F.least(F.col("n"), F.col("n") - least + LEVELS) - held)
    return whole.withColumn("most", F.col("n") - alone).where((held >= F.least(F.lit(LEVELS), least)) & (F.col("most") >= least)).select("num", "most")


_POSTING = ("token", "cell", "block", "num", "n", "place", "own", "most", *SIGNS)
_POSTINGS = ", ".join(f"{c} {'int' if c == 'own' else 'long'}" for c in _POSTING)


def postings(numbered: DataFrame) -> DataFrame:
    """The columns of _POSTING. Sets meet in a cell, the whole list of a shingle or two of its blocks; each may link with another one there."""
    buckets = bucket_count(numbered)
    packed = map_arrow(numbered.select("num", "n", "level", "rare", "tokens"), lambda b: _entries(b, buckets), "bucket int, base long, rows binary")
    met = materialize(dealt(packed, buckets).applyInArrow(_met, _MET))
    signed = _bounded(met).join(numbered.select("num", *SIGNS), "num")
    met = materialize(met.join(signed, "num"), drop=met)
    wide = materialize(met.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > WIDE))
    none = F.lit(0).cast("long")
    if wide.isEmpty():
        cells = met.withColumns({"cell": none, "block": none})
    else:
        narrow = met.join(wide, "token", "left_anti").withColumns({"cell": none, "block": none})
        blocks = F.ceil(2 * F.col("size") / WIDE).cast("long")
        parts = met.join(wide, "token").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("num"), "blocks"))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        parts = parts.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
        cells = narrow.select(*_POSTING).unionByName(parts.select(*_POSTING))
    near = materialize(map_arrow(_together(cells.select(*_POSTING)), _near, _POSTINGS), drop=met)
    return materialize(near.drop("most").join(_bounded(near), "num").select(*_POSTING), drop=near)


# ---------------------------------------------------------------- pairs


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys, from sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            same &= v[1:] == v[:-1]
        ends = np.flatnonzero(~same)
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(ends):
            cut = int(ends[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """The first row of each row's run of equal values, as the run's number."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


_PAIRS = "a long, b long, need long"


def _may_link(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets of rows a and b may link, by what they can share with anyone and by their signatures."""
    n = c["n"][a] + c["n"][b]
    least = -(-LINK * n // (LINK + OUT_OF))
    good = (np.minimum(c["most"][a], c["most"][b]) >= least) & (c["one"][a] | (c["block"][a] != c["block"][b]))
    at = np.flatnonzero(good)
    differ = sum(np.bitwise_count((c[s][a[at]] ^ c[s][b[at]]).view(np.uint64)).astype(np.int64) for s in SIGNS)
    good[at] = n[at] - differ >= 2 * least[at]
    return good


def _open(table: pa.Table, label: str) -> dict[str, np.ndarray]:
    """The rows of cells that hold more than one label, in the order of set sizes. row: in the table; run: the cell's number; one: it isn't made of two blocks."""
    c = {k: table.column(k).to_numpy() for k in table.column_names}
    run = _starts([c["token"], c["cell"]])

    def mixed(x: np.ndarray) -> np.ndarray:
        low, high = np.full(run[-1] + 1, np.iinfo(np.int64).max), np.full(run[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, run, x)
        np.maximum.at(high, run, x)
        return (low < high)[run]

    kept = np.flatnonzero(mixed(c[label]))
    kept = kept[np.lexsort((c["num"][kept], c["n"][kept], run[kept]))]
    return {k: v[kept] for k, v in (c | {"run": run, "one": ~mixed(c["block"]), "row": np.arange(len(run))}).items()}


def _meetings(c: dict[str, np.ndarray], other) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a, b of one cell whose sets may link, a's the smaller one. other: which of such pairs are asked for."""
    n, run = c["n"], c["run"]
    at, d = np.arange(len(run)), 1
    while len(at := at[at + d < len(run)]):
        at = at[(run[at] == run[at + d]) & (LINK * n[at + d] <= OUT_OF * n[at])]  # sizes rise, so who has no partner at d has none beyond
        a = at[other(at, at + d)]
        a = a[_may_link(c, a, a + d)]
        if len(a):
            yield a, a + d
        d += 1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The postings that meet one with whose set theirs may link."""
    for table in _runs(batches, ["token", "cell"]):
        c = _open(table, "num")
        kept = np.zeros(len(c["num"]), bool)
        for a, b in _meetings(c, lambda a, b, kept=kept: ~(kept[a] & kept[b])):
            kept[a] = kept[b] = True
        yield {k: c[k][kept] for k in _POSTING}


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sets with different labels that meet, once for each shingle at which they do. a: the smaller set, which probes at its level, need.

    Sets that link share `least` shingles or more, so the first `need` of these stand among the first n - least + need of each.
    """
    for table in _runs(batches, ["token", "cell"]):
        c = _open(table, "label")
        n, num, own, place, label = (c[k] for k in ("n", "num", "own", "place", "label"))

        def other(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            least = -(-LINK * (n[a] + n[b]) // (LINK + OUT_OF))  # noqa: B023
            return (label[a] != label[b]) & (np.maximum(place[a] - n[a], place[b] - n[b]) < own[a] - least)  # noqa: B023

        for a, b in _meetings(c, other):
            yield {"a": num[a], "b": num[b], "need": own[a].astype(np.int64)}


def _tried(batches: Iterator[pa.RecordBatch], wave: int) -> Iterator[dict]:
    """For each set (b) two sets (a) of other labels that it meets at a shingle: one of those that may share most with others (the next ones in each wave), and its neighbour in that order."""
    for table in _runs(batches, ["token", "cell"]):
        c = _open(table, "label")
        order = np.lexsort((c["num"], c["n"] - c["most"], c["run"]))
        c = {k: v[order] for k, v in c.items()}
        num, run, label = (c[k] for k in ("num", "run", "label"))
        at = np.arange(len(run))
        first = np.searchsorted(run, run)
        for to in (first + wave, at - 1):
            b = at[(to >= first) & (to < len(run))]
            a = to[b]
            good = (run[a] == run[b]) & (label[a] != label[b])
            a, b = a[good], b[good]
            good = _may_link(c, a, b)
            yield {"a": num[a[good]], "b": num[b[good]]}


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows are sorted by a, salt and other: a set (other = 0), then those to compare it with."""
    hub, of = np.empty(0, np.uint64), None
    for batch in batches:
        a, num, other, n = (batch.column(c).to_numpy() for c in ("a", "num", "other", "n"))
        h = batch.column("h")
        hits = []
        for k in range(batch.num_rows):
            own = np.frombuffer(h[k].as_py(), np.uint64)
            if not other[k]:
                hub, of = own, a[k]
                continue
            assert of == a[k]
            both = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
            if OUT_OF * both >= LINK * (len(hub) + len(own) - both):
                hits.append(k)
        yield {"a": a[hits], "b": num[hits]}


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link. Each set a goes to its partners STAR at a time."""
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("long").alias("salts"))
    partners = pairs.join(stars, "a").select("a", F.col("b").alias("num"), F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.lit(1).alias("other"))
    hubs = stars.select("a", F.col("a").alias("num"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("other"))
    rows = partners.unionByName(hubs).join(sets, "num").select("a", "salt", "other", "num", "n", "h")
    return map_arrow(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other"), _compared, "a long, b long")


def _needed(batches: Iterator[pa.RecordBatch], packed: bytes, width: int) -> Iterator[dict]:
    """Sets of the texts whose hash may be among those that are needed; of copies in one task the first."""
    wanted, seen = np.unpackbits(unpack(packed, "u1")), set()
    for batch in batches:
        th = batch.column("th").to_numpy()
        rows = np.array([k for k in np.flatnonzero(wanted[_places(th.view(np.uint64), width)]).tolist() if not (th[k] in seen or seen.add(th[k]))], np.int64)
        text = batch.column("text").cast(pa.binary())
        found = [shingles(text[k].as_py()) for k in rows.tolist()]
        yield {"th": th[rows], "key": [key_of(h) for h in found], "h": [h.tobytes() for h in found]}


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """num, n, h of the needed sets (num, key, th, n). Of the other texts hardly any is hashed or moved."""
    bits = np.packbits(sketch(needed.select("th"), lambda b: [b.column("th").to_numpy().view(np.uint64)], WIDTH) > 0)
    found = map_arrow(docs.select("th", "text"), lambda b: _needed(b, pack(bits), WIDTH), "th long, key binary, h binary")
    return found.join(needed.select("num", "key", "th", "n"), ["key", "th"]).groupBy("num", "n").agg(F.first("h").alias("h"))


def _together(postings: DataFrame) -> DataFrame:
    """The postings of a cell together."""
    return postings.repartition("token", "cell").sortWithinPartitions("token", "cell")


def _labelled(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings with their sets' labels, those of a cell together."""
    if labels is None:
        return _together(met.withColumn("label", F.col("num")))
    return _together(met.join(labels, met["num"] == labels["node"], "left").select(met["*"], F.coalesce("label", "num").alias("label")))


def links(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """a, b: links that connect whatever links connect."""
    met = postings(numbered)
    sets = materialize(_sets(docs, numbered.join(met.select("num").distinct(), "num", "left_semi")))
    found, labels, total = None, None, 0
    for wave in range(WAVES):
        shared = map_arrow(_labelled(met, labels), lambda b, w=wave: _tried(b, w), "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        # the set that it meets most often; ties go to the least number
        pairs = materialize(shared.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")))
        new = verified(pairs, sets)
        found = materialize(new if found is None else found.unionByName(new), drop=found)
        tried, before, total = pairs.count(), total, found.count()
        if total > before:
            labels = components(found)
        if FEW * (total - before) < tried or not tried:
            break
    shared = map_arrow(_labelled(met, labels), _pairs, _PAIRS).groupBy("a", "b", "need").agg(F.count(F.lit(1)).alias("shared"))
    last = verified(materialize(shared.where("shared >= need").select("a", "b")), sets)
    return last if found is None else found.unionByName(last)


def linked(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    rank_of = pack(ranks(sketch(docs.select("text"), _hashes, WIDTH)))
    sets = materialize(map_arrow(docs, lambda b: _prefixes(b, rank_of), f"doc_id long, th long, key binary, n long, level int, rare int, tokens binary, {', '.join(f'{c} long' for c in SIGNS)}"))
    distinct = sets.where("n > 0").select("key", "th", "n", "level", "rare", "tokens", *SIGNS).dropDuplicates(["key"])
    numbered = materialize(distinct.withColumn("num", F.monotonically_increasing_id()))
    labels = components(links(docs, numbered))
    first = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"))
    of = numbered.select("key", "num").join(labels, F.col("num") == labels["node"], "left").select("key", F.coalesce("label", "num").alias("label"))
    of = materialize(of.join(first, "key"))
    least = of.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = of.join(least, "label").select("key", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12(documents: DataFrame) -> DataFrame:
    return linked(documents)
