"""SimHash near-duplicates by pivot distance tables.

A document's fingerprint has 64 bits; fingerprints link at MAX_BITS or fewer differing bits. Equal fingerprints become one
row first, so copies cost nothing further. Each different fingerprint gets its row of the pivot table once: its Hamming
distances to N_PIVOTS reference fingerprints, which it carries along.

Fingerprints meet where they agree on all but MAX_BITS of some blocks of bits: of r blocks, MAX_BITS differing bits leave
r - MAX_BITS untouched, so each linked pair meets under at least one choice of blocks. Among those that meet, the pivot table
discards pairs: distances of two linked fingerprints to one reference differ by MAX_BITS at most, so a pair with a larger
difference in any coordinate is dropped; survivors are verified bit by bit. The search is exact.

The number of blocks follows the number of fingerprints, so that a meeting stays small. A meeting that is wider than WIDE is
split by blocks of its remaining bits, which is exact for the same reason, up to DEPTH times. What is still wide is compared in
blocks of rows, a task for each pair of blocks, so no task holds a whole wide meeting.
Links (a spanning forest of each meeting) go to connected components.

Defined results: a null or empty text has the fingerprint zero, which links like any other; texts of any length are read
whole; repeated rows and equal texts share their component, of equal ids it makes no difference which one names it; null ids never name a component (one whose ids are all null has
a null id); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .components import components

WORDS = 3
MAX_BITS = 3
SEED = 42
N_PIVOTS = 16
WIDE = 4096
DEPTH = 1
#: Fingerprints that share a meeting on the average, at most.
SHARE = 4


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    import xxhash

    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return 0
    grams = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 15):
        part = h[s : s + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def majority(h: np.ndarray) -> np.ndarray:
    """The fingerprint of hashes of several words each (a row for each shingle): bits that are set in over half the rows."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for s in range(0, len(h), 255):  # a byte holds the count
        ones += np.unpackbits(np.ascontiguousarray(h[s : s + 255], "<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[dict]:
    for batch in batches:
        found = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
        yield {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence (splitmix64 from 1)."""
    mask, out = (1 << 64) - 1, []
    for k in range(1, n + 1):
        z = (k * 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def block_masks(bits: int, r: int, least: int) -> list[int]:
    """The bits of a mask in r blocks of nearly equal size; the unions of each r - least of them."""
    places = [i for i in range(64) if bits >> i & 1]
    edges = [len(places) * i // r for i in range(r + 1)]
    blocks = [sum(1 << p for p in places[s:e]) for s, e in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, r - least)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The pivot table: each fingerprint with its distances to the references, a byte each."""
    refs = pivots()
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        table = np.bitwise_count(fp[:, None] ^ refs).astype(np.uint8)
        yield {"fp": batch.column("fp"), "table": [x.tobytes() for x in table]}


@lru_cache(maxsize=1 << 16)
def _deeper(mask: int, max_bits: int) -> list[int]:
    """A mask with each of max_bits + 1 blocks of its other bits."""
    return [mask | x for x in block_masks(((1 << 64) - 1) & ~mask, max_bits + 1, max_bits)]


def _split(batches: Iterator[pa.RecordBatch], max_bits: int, masks: list[int] | None = None) -> Iterator[dict]:
    """A row of mask and bits for each choice of blocks: these masks, or those below the row's own."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        own = batch.column("mask").to_numpy(zero_copy_only=False).astype(np.int64) if masks is None else np.zeros(len(fp), np.int64)
        at, new = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for m in np.unique(own).tolist():
            rows = np.flatnonzero(own == m)
            for x in _deeper(m & ((1 << 64) - 1), max_bits) if masks is None else masks:
                at.append(rows)
                new.append(np.full(len(rows), signed(x)))
        at, new = np.concatenate(at), np.concatenate(new)
        yield {"fp": fp[at], "table": batch.column("table").take(pa.array(at)), "mask": new, "bits": fp[at] & new}


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[dict]:
    """Rows are sorted by meeting. Emits a spanning forest of each meeting's linked pairs."""
    held = None

    def search(mask: np.ndarray, bits: np.ndarray, cell: np.ndarray, fp: np.ndarray, table: np.ndarray) -> dict:
        root, kept = np.arange(len(fp)), []  # root: of each row, kept flat between offsets

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x] = root[root[x]]
            return x

        at, d = np.arange(len(fp)), 1
        while True:
            at = at[at + d < len(fp)]
            at = at[(mask[at] == mask[at + d]) & (bits[at] == bits[at + d]) & (cell[at] == cell[at + d])]
            if not len(at):
                break
            i, j = at, at + d
            for c in range(table.shape[1]):  # a coordinate at a time: most pairs go at the first few
                near = np.abs(table[i, c] - table[j, c]) <= max_bits
                i, j = i[near], j[near]
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & (root[i] != root[j])
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    kept.append((x, y))
            while near.any() and (root != (up := root[root])).any():
                root = up
            d += 1
        pairs = np.array(kept, np.int64).reshape(-1, 2)
        return {"a": fp[pairs[:, 0]].view(np.int64), "b": fp[pairs[:, 1]].view(np.int64)}

    for batch in batches:
        own = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("mask", "bits", "cell", "fp")]
        own[3] = own[3].view(np.uint64)
        own.append(np.frombuffer(b"".join(batch.column("table").to_pylist()), np.uint8).astype(np.int8).reshape(len(own[0]), -1))
        if not len(own[0]):
            continue
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        open_ = np.flatnonzero(np.any([k != k[-1] for k in held[:3]], axis=0))
        cut = open_[-1] + 1 if len(open_) else 0  # the last meeting may go on in the next batch
        if cut:
            yield search(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield search(*held)


_MET = "fp long, table binary, mask long, bits long"


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS, wide: int = WIDE) -> DataFrame:
    """a, b: pairs of fingerprints that connect what links at max_bits. distinct: fp, n rows."""
    r = max_bits + 1
    while r < 8 and n > SHARE << (64 * (r - max_bits) // r):
        r += 1
    masks = block_masks((1 << 64) - 1, r, max_bits)
    table = map_arrow(distinct.select("fp"), _with_pivots, "fp long, table binary")
    rows = map_arrow(table, lambda b: _split(b, max_bits, masks), _MET)
    narrow, keys = None, ["mask", "bits"]
    for depth in range(DEPTH + 1):
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > wide)
        wide_keys = materialize(sizes)
        done = rows.join(wide_keys, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("cell"), "fp", "table")
        narrow = done if narrow is None else narrow.unionByName(done)
        if wide_keys.isEmpty():
            break
        rows = rows.join(wide_keys, keys)
        if depth < DEPTH:
            # a fingerprint may reach one meeting by several ways
            rows = materialize(map_arrow(rows.select("fp", "table", "mask"), lambda b: _split(b, max_bits), _MET).distinct())
        else:
            blocks = F.ceil(F.col("size") / (wide / 2)).cast("long")
            rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            cell = F.least("block", "other") * blocks + F.greatest("block", "other")
            narrow = narrow.unionByName(rows.select(*keys, cell.alias("cell"), "fp", "table"))
    sorted_ = narrow.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "fp")
    return map_arrow(sorted_, lambda b: _links(b, max_bits), "a long, b long")


def near_groups(documents: DataFrame, *, words: int = WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links reach."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(map_arrow(docs, lambda b: _fingerprints(b, words, seed), "doc_id long, fp long"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(links(distinct.select("fp"), distinct.count(), max_bits))
    labelled = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labelled.join(least, "label").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def op6(documents: DataFrame) -> DataFrame:
    return near_groups(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, one of each group of near copies (SimHash and pivot tables, see nearcopies): the one with the least doc_id, then the least hash of its text.

    All columns stay. Null and empty texts are copies of each other; of repeated rows (same id, same text) one stays;
    different texts of one id are told apart; rows without an id take part, behind all others; an empty table stays empty.
    """
    from .nearcopies import near_copies  # it takes this module's blocks, pivots and majority

    groups = materialize(near_copies(documents))
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th")))
    repeated = not kept.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    kept = kept.select(F.col("doc_id").alias("__kept_id"), F.col("th").alias("__kept_th")).distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]) & (F.xxhash64(documents["text"]) == kept["__kept_th"])
    out = documents.join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
