"""Near copies: texts whose sets of WORDS-word shingles have a Jaccard similarity of 0.8 (NEAR / OUT_OF) or more, by SimHash and pivot tables.

Equal sets (by 128 bits of hash) become one row first, so copies cost nothing further. At similarity 0.8 fingerprints differ by
15 % of their bits on the average (sets of 14 or more shingles: 16.2 % at most), which no pivot bounds in one fingerprint of 64
bits. So each set has PRINTS independent fingerprints of BITS bits, and is searched in each as simhash does it: fingerprints meet
where they agree on all but MAX_BITS of some blocks of bits, pivot distances discard pairs, survivors are verified bit by bit at
MAX_BITS. A pair at 0.8 links in one fingerprint with probability 0.27, in none with 4e-5 (2e-4 at 16.2 %; 7e-3 for five shingles
with four of them, the one case beyond). CHECK further bits, at most CHECK_MAX of which may differ, leave unrelated sets out:
they link with a probability of 1e-15.

Fingerprints are searched in WAVES. What one wave links shares a label, and goes into the next wave by it, so a group of near
copies adds hardly more edges than it has sets, however many meetings they share. The sets of one label are a cluster. Each set
goes on once, with its cluster. There sizes and the bits that differ among all of the sketch discard pairs (a share above FAR:
over four standard deviations beyond 16.2 %; sets of fewer than SMALL shingles have SMALL_FAR); whatever is left is compared
exactly, so no other pair ever links. A search from row to row leaves out pairs that are together already, so large groups of
near copies cost few comparisons.

Entries of meetings (fingerprint, check bits, number of the set) travel packed, 44 bytes each; a pivot table would take 16 more,
so it is computed where they meet. Clusters of more than WIDE sets or HELD shingles are compared in blocks, a task for each pair
of blocks, so that no task holds a whole one.

Defined results: a text shorter than WORDS words is one shingle; null and empty texts have the empty set, which is equal to
itself only; words are split at ASCII white space, A-Z are lowered; texts of any length are read whole; rows without an id take
part, behind all others; equal texts and repeated rows share their group; different texts of one id are told apart by their hash
th; of equal ids the least hash is first; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, map_arrow, materialize
from .components import components
from .simhash import block_masks, majority, pivots

WORDS = 5
NEAR, OUT_OF = 4, 5
PRINTS, BITS, MAX_BITS = 32, 24, 2
#: Fingerprints that are searched before labels are found anew.
WAVES = ((0, 1), (1, 4), (4, PRINTS))
CHECK, CHECK_MAX = 256, 72
FAR = 0.217
SMALL, SMALL_FAR = 6, 0.25
#: Sets and shingles in a block of a cluster, and unrelated sets that may share a meeting.
WIDE, HELD, SHARED = 1 << 14, 1 << 22, 4096
#: Meetings wider than this meet once more by blocks of their other bits, since unrelated sets in a meeting grow with the input.
SPLIT = 64
#: Meetings from here on are searched row by row, smaller ones all at once.
LARGE = 256
#: Entries that a task of the search holds, and sets that are dealt out at once.
ENTRIES, SETS = 1 << 19, 2048
SEED = 42
SKETCH = (PRINTS * BITS + CHECK) // 64
_SALTS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, SKETCH, np.uint64)
#: A set's number has 48 bits, in two fields.
_ENTRY = np.dtype([("check", "<u8", CHECK // 64), ("fp", "<u4"), ("low", "<u4"), ("high", "<u2"), ("slot", "<u2")])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64))


def fingerprints(h: np.ndarray) -> np.ndarray:
    """The set's SimHash bits, as words: PRINTS fingerprints and the check bits. Each word has its own hash of the shingles (splitmix64)."""
    z = h[:, None] + _SALTS
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(z ^ (z >> np.uint64(31)))


def _key(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes(), SEED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        keys, sizes, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            h = shingles(text)
            keys.append(_key(h))
            sizes.append(len(h))
            sketches.append(fingerprints(h).tobytes())
        yield {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "key": keys, "n": np.array(sizes, np.int64), "sketch": sketches}


def _prints(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (a row of bytes each) as fingerprints and check bits."""
    parts = sketch[:, : PRINTS * BITS // 8].reshape(len(sketch), PRINTS, BITS // 8).astype(np.uint32)
    return (parts << np.arange(0, BITS, 8, dtype=np.uint32)).sum(axis=2, dtype=np.uint32), np.ascontiguousarray(sketch[:, PRINTS * BITS // 8 :]).view("<u8")


def _entries(batches: Iterator[pa.RecordBatch], masks: np.ndarray, buckets: int, prints: tuple[int, int] = (0, PRINTS)) -> Iterator[dict]:
    """Packed entries by bucket: a set has one for each slot, that is a fingerprint of a wave and a choice of blocks."""
    slot = np.arange(prints[0] * len(masks), prints[1] * len(masks))
    for batch in batches:
        for s in range(0, batch.num_rows, SETS):
            part = batch.slice(s, SETS)
            num = part.column("num").to_numpy()
            fp, check = _prints(np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(len(num), -1))
            fp = fp[:, prints[0] : prints[1]]
            entries = np.empty((len(num), len(slot)), _ENTRY)
            entries["check"], entries["fp"], entries["slot"] = check[:, None], np.repeat(fp, len(masks), axis=1), slot
            entries["low"], entries["high"] = (num & 0xFFFFFFFF)[:, None], (num >> 32)[:, None]
            meeting = (fp[:, :, None] & masks).reshape(len(num), -1).astype(np.uint64) << np.uint64(16) | slot.astype(np.uint64)
            to = ((meeting * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32).reshape(-1)
            order = np.argsort(to, kind="stable")
            to, entries = to[order], entries.reshape(-1)[order]
            edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]])
            yield {"bucket": to[edges[:-1]], "rows": [entries[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]}


def _linked(fp: np.ndarray, check: np.ndarray, ends: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """For each row the first row of those that links join with it. Rows of a meeting are neighbours; ends: where each row's meeting ends.

    mask: the bits in which each row's meeting agrees. Wide meetings are then split by blocks of the other bits: MAX_BITS of them may
    differ, so each linked pair agrees on all but MAX_BITS of the blocks, and links join what they join in the whole meeting.
    """
    refs = pivots().astype(np.uint32) & np.uint32((1 << BITS) - 1)
    table = np.bitwise_count(fp[:, None] ^ refs).astype(np.int8)
    root = np.arange(len(fp))

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs link; j holds one row or as many as i."""
        at = np.arange(len(i))
        j = np.broadcast_to(j, i.shape)
        for c in range(table.shape[1]):  # a coordinate at a time: most pairs go at the first few
            at = at[np.abs(table[i[at], c] - table[j[at], c]) <= MAX_BITS]
        at = at[np.bitwise_count(fp[i[at]] ^ fp[j[at]]) <= MAX_BITS]
        return at[np.bitwise_count(check[i[at]] ^ check[j[at]]).sum(axis=1) <= CHECK_MAX]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(i: np.ndarray, j: np.ndarray) -> None:
        """Links of rows i with rows j, none of which are joined yet."""
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
        if len(i):
            rows = np.concatenate([i, j])
            root[rows] = [find(x) for x in rows.tolist()]

    starts = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]])[: len(ends)])
    sizes = ends[starts] - starts
    wide = sizes > SPLIT if mask is not None else np.zeros(len(starts), bool)
    if wide.any():
        at = np.flatnonzero(np.repeat(wide, sizes))
        kinds, kind = np.unique(mask[at], return_inverse=True)
        choices = np.array([block_masks(~int(m) & ((1 << BITS) - 1), MAX_BITS + 2, MAX_BITS) for m in kinds], np.int64)
        for c in range(choices.shape[1]):
            cell = np.repeat(np.arange(len(starts)), sizes)[at] << BITS | fp[at] & choices[kind, c]
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
            own = np.diff(edges)
            rows, own = at[order][np.repeat(own > 1, own)], own[own > 1]
            first = rows[_linked(fp[rows], check[rows], np.repeat(np.cumsum(own), own))]
            new = root[first] != root[rows]
            join(first[new], rows[new])
    large = (sizes > LARGE) & ~wide
    for s in starts[large].tolist():
        left = np.arange(s, ends[s])
        while len(left):
            first, left = left[0], left[1:]
            queue = [first]
            while queue and len(left):
                hit = near(left, np.array(queue.pop()))
                root[left[hit]] = first
                queue.extend(left[hit].tolist())
                left = np.delete(left, hit)
    small = np.repeat(~large & ~wide, sizes)
    at, d = np.flatnonzero(small), 1
    while len(at := at[at + d < ends[at]]):
        hit = near(at, at + d)
        i = at[hit]
        i = i[root[i] != root[i + d]]
        join(i, i + d)
        d += 1
    while (root != (up := root[root])).any():
        root = up
    return root


def _searched(table: pa.Table, masks: np.ndarray) -> pa.Table:
    """Of a bucket's meetings, the sets that links join: meet names their first set and the slot."""
    entries = np.frombuffer(b"".join(table.column("rows").to_pylist()), _ENTRY)
    num = entries["high"].astype(np.int64) << 32 | entries["low"]
    slot = entries["slot"].astype(np.int64)
    meeting = slot << BITS | entries["fp"] & masks[slot % len(masks)]
    order = np.lexsort((num, meeting))  # so the first set of a meeting doesn't hang on the order of arrival
    meeting = meeting[order]
    edges = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]]))
    sizes = np.diff(edges)
    order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    root = _linked(entries["fp"][order], entries["check"][order], np.repeat(np.cumsum(sizes), sizes), masks[slot[order] % len(masks)])
    kept = np.bincount(root, minlength=len(root))[root] > 1
    num, slot = num[order], slot[order]
    return pa.table({"meet": (num[root] * (PRINTS * len(masks)) + slot)[kept], "num": num[kept], "slot": slot[kept]})


def _edges(found: pa.Table, slots: int) -> pa.Table:
    """a, b: numbers that a bucket's meetings join, each pair once."""
    a, b = found.column("meet").to_numpy() // slots, found.column("num").to_numpy()
    pairs = np.unique(np.stack([a, b])[:, a != b], axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


class Cluster:
    """Sets of a cluster (h: their shingles), or of two of its blocks; sets of one block are then not compared with each other."""

    def __init__(self, sketch: np.ndarray, block: np.ndarray, h: list[bytes]):
        self.sketch = np.ascontiguousarray(sketch).view("<u8")
        self.block = block if block.min() != block.max() else None
        self.n = np.array([len(x) // 8 for x in h])
        self.h, self.ids, self.own = h, None, None

    def near(self, x: int, of: np.ndarray) -> np.ndarray:
        """Which of these rows may link with x."""
        if self.block is not None:
            of = of[self.block[of] != self.block[x]]
        of = of[OUT_OF * np.minimum(self.n[of], self.n[x]) >= NEAR * np.maximum(self.n[of], self.n[x])]
        far = np.bitwise_count(self.sketch[of] ^ self.sketch[x]).sum(axis=1, dtype=np.int64) / (64 * SKETCH)
        return of[far <= np.where(np.minimum(self.n[of], self.n[x]) < SMALL, SMALL_FAR, FAR)]

    def linked(self, x: int, of: np.ndarray) -> np.ndarray:
        """Which of these rows link with x: the sets themselves are compared."""
        of = self.near(x, of)
        if not len(of):
            return of
        if self.ids is None:  # shingles are numbered when the first pair needs it
            names, ids = np.unique(np.frombuffer(b"".join(self.h), np.uint64), return_inverse=True)
            self.ids, self.own = np.split(ids, np.cumsum(self.n)[:-1]), np.zeros(len(names), bool)
        self.own[self.ids[x]] = True
        starts = np.cumsum(self.n[of]) - self.n[of]
        both = np.add.reduceat(self.own[np.concatenate([self.ids[y] for y in of.tolist()])], starts, dtype=np.int64)
        self.own[self.ids[x]] = False
        return of[OUT_OF * both >= NEAR * (self.n[of] + self.n[x] - both)]

    def forest(self) -> Iterator[tuple[int, np.ndarray]]:
        """Links that join whatever links join."""
        left = np.arange(len(self.n))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                hit = self.linked(x, left)
                if len(hit):
                    yield x, hit
                    queue.extend(hit.tolist())
                    left = np.setdiff1d(left, hit, assume_unique=True)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows are sorted by meet: a cluster, or two of its blocks."""
    held: list[pa.RecordBatch] = []

    def search(table: pa.Table) -> dict:
        table = table.combine_chunks()
        meet, key, block = (table.column(k).to_numpy() for k in ("meet", "key", "block"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(key), -1)
        edges = np.concatenate([[0], np.flatnonzero(meet[1:] != meet[:-1]) + 1, [len(meet)]])
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for x, hit in Cluster(sketch[s:e], block[s:e], table.column("h").slice(s, e - s).to_pylist()).forest():
                a.append(np.full(len(hit), key[s + x]))
                b.append(key[s + hit])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    for batch in batches:
        if not batch.num_rows:
            continue
        meet = batch.column("meet").to_numpy()
        ends = np.flatnonzero(meet[1:] != meet[:-1])
        if held and held[-1].column("meet")[-1].as_py() != meet[0]:
            yield search(pa.Table.from_batches(held))
            held = []
        if len(ends):  # the last cluster may go on in the next batch
            cut = int(ends[-1]) + 1
            yield search(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield search(pa.Table.from_batches(held))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield {"key": batch.column("key"), "h": [shingles(t).tobytes() for t in batch.column("text").to_pylist()]}


def _masks(n: int) -> np.ndarray:
    """The choices of blocks for n sets: as few blocks as keep a meeting of unrelated sets below SHARED."""
    r = MAX_BITS + 2
    while r < 8 and n > SHARED << (BITS * (r - MAX_BITS) // r):
        r += 1
    return np.array(block_masks((1 << BITS) - 1, r, MAX_BITS), np.uint32)


def _labels(edges: DataFrame) -> DataFrame:
    """node, label: for each second end of an edge the least first end, and that one's own. All of a label's sets are connected."""
    one = edges.groupBy("b").agg(F.min("a").alias("a"))
    up = one.select(F.col("b").alias("a"), F.col("a").alias("up"))
    return one.join(up, "a", "left").select(F.col("b").alias("node"), F.coalesce("up", "a").alias("label"))


def _numbered(sets: DataFrame) -> DataFrame:
    """The sets with num, from 0 without gaps, so that it stays short. The counts that it takes are as many as there are tasks."""
    found = materialize(sets.withColumn("__id", F.monotonically_increasing_id()))
    task = F.shiftright("__id", 33)
    sizes = found.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__task", (F.sum("__size").over(Window.orderBy("__task")) - F.col("__size")).alias("__before"))
    at = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return materialize(found.join(F.broadcast(before), task == F.col("__task")).select(*sets.columns, at.alias("num")), drop=found)


def _clusters(numbered: DataFrame, n: int, masks: np.ndarray) -> DataFrame:
    """num, cluster: the sets that links join, over all meetings, each in one row.

    In each wave sets go by the label that they have so far, a least number that earlier links reach, so a meeting adds an edge
    only where it joins labels. Labels needn't be whole components yet; those are found once, from the edges of all waves.
    """
    slots = PRINTS * len(masks)
    found = None
    for prints in WAVES:
        own = numbered.select("num", "sketch")
        if found is not None:
            labels = _labels(found)
            own = own.join(labels, own["num"] == labels["node"], "left").select(F.coalesce("label", "num").alias("num"), "sketch")
        buckets = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (prints[1] - prints[0]) * len(masks) // ENTRIES + 1)
        entries = map_arrow(own, lambda b, w=prints, k=buckets: _entries(b, masks, k, w), "bucket int, rows binary")
        edges = materialize(dealt(entries, buckets).applyInArrow(lambda t: _edges(_searched(t, masks), slots), "a long, b long").distinct())
        found = edges if found is None else found.unionByName(edges)
    return components(found).select(F.col("node").alias("num"), F.col("label").alias("cluster"))


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash) and the first row that links reach: component_id, the least doc_id (null: all ids are null), and component_th."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sets = materialize(map_arrow(docs, _sets, "doc_id long, th long, key binary, n long, sketch binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    distinct = materialize(sets.groupBy("key").agg(first).select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")))
    of_key = sets.join(distinct, (sets["key"] == distinct["key"]) & sets["doc_id"].eqNullSafe(distinct["doc_id"]) & (sets["th"] == distinct["th"]), "left_semi")
    numbered = _numbered(of_key.where("n > 0").select("key", "n", "sketch").dropDuplicates(["key"]))
    n = numbered.count()
    masks = _masks(n)
    # from here on a set goes by its number
    sketches = materialize(_clusters(numbered, n, masks).join(numbered, "num").select(F.col("num").alias("key"), "cluster", "n", "sketch"))
    named = distinct.join(numbered.select("key", "num"), "key", "left").select(distinct["key"], "doc_id", "th", F.coalesce("num", F.lit(-1)).alias("num"))
    reps = named.join(sketches, named["num"] == sketches["key"], "left_semi").select(F.col("num").alias("key"), F.col("doc_id").alias("rep_id"), F.col("th").alias("rep_th"))
    texts = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep_id"]) & (docs["th"] == reps["rep_th"])).select("key", "text")
    hashes = map_arrow(texts, _hashes, "key long, h binary").dropDuplicates(["key"])
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / WIDE, F.sum("n") / HELD)).cast("long")
    rows = sketches.join(sketches.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(F.when(F.col("blocks") == 1, F.col("cluster")).otherwise(pair).alias("meet"), "key", "block", "sketch")
    met = hashes.join(rows, "key").repartition("meet").sortWithinPartitions("meet", "key")
    labels = components(map_arrow(met, _links, "a long, b long"))
    labelled = materialize(named.join(labels, named["num"] == labels["node"], "left").select("key", "doc_id", "th", F.coalesce("label", "num").alias("label")))
    least = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    least = least.select("label", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("component_th"))
    return sets.select("doc_id", "th", "key").join(labelled.select("key", "label"), "key").join(least, "label").select("doc_id", "th", "component_id", "component_th")
