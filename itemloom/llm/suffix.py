"""Repeated passages by a sparse suffix array.

A repeat is a run of MIN_WORDS words that occurs again, in another document or elsewhere in the same one. The first
occurrence (least doc_id, then the text's hash, then position) stays; the others are to be removed.

1. Suffixes are retained at minimiser positions only: in each MIN_WORDS-word window, the position with the least hash of its
   first few words, among the first SPREAD positions. The choice depends on content alone, so two equal windows retain
   the same position, and the PREFIX = MIN_WORDS - SPREAD + 1 words from there lie inside the window.
2. A filter: suffixes meet by a hash of their prefix, and those that meet nothing are dropped; then the windows around the
   others meet by a hash, and what meets nothing is dropped again. Equal content has equal hashes, so nothing is lost here;
   a collision only lets more through.
3. The suffix array: each retained suffix, with the words before and behind it that lie in a window which met another, is
   dealt out by its prefix. In each range the suffixes are sorted by their words, neighbours are compared, which gives the
   lengths of their common prefixes, and matches are extended to the left word by word. Runs of suffixes whose right and left
   matches add up to MIN_WORDS words are repeats. Words themselves are compared here, no hashes.

No match of MIN_WORDS words is lost, none shorter is reported, and nothing is reported on the strength of a hash.

What a chunk of documents holds many times leaves the chunk once, in each step, so a passage in a third of all documents
makes no large group anywhere: a range holds the different contexts that share a prefix, once for each chunk. The number of
ranges, and of tasks for them, follows the input's size.

Defined results: words are runs outside ASCII white space; a null or short text has no repeats; texts of any length are
read whole; of periodic texts the first MIN_WORDS words stay; repeated rows (same id, same text) count as one document, and
different texts of one id as documents of their own, with a row each; rows with a null id take part, behind all others;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, dealt, map_arrow, materialize, pack, unpack, word_spans

MIN_WORDS = 50
SPREAD = 31
PREFIX = MIN_WORDS - SPREAD + 1
#: Words whose hash ranks a position.
RANK_WORDS = 5
#: Words that are hashed together, and entries that a chunk holds before it is dealt out; both bound a task's memory.
SLICE_WORDS = 1 << 19
CHUNK_ENTRIES = 1 << 21
CHUNK_CONTEXTS = 1 << 17
#: Bits of the filters' hashes: more are longer to carry, fewer let more through.
HASH_BITS = 48
#: The id of rows without one: behind all others.
NO_ID = (1 << 63) - 1


class WordNumbers(dict):
    """Words to numbers in order of their first use, with their hashes."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(word_hash(word))
        return n


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15) + y
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words: halves are put together, powers of two first."""
    out, done, power, size = None, 0, words, 1
    while True:
        if n & size:
            out = power if out is None else _mix(out[: len(power) - done], power[done:]) if len(power) > done else power[:0]
            done += size
        size *= 2
        if size > n:
            return out[: max(0, len(words) - n + 1)]
        power = _mix(power[: -(size // 2)], power[size // 2 :]) if len(power) > size // 2 else power[:0]


def least_in_window(rank: np.ndarray, w: int) -> np.ndarray:
    """For each start, the first position of the least rank among the w from there."""
    at, best, span = np.arange(len(rank)), rank, 1
    while span < w:
        step = min(span, w - span)
        left, right = best[:-step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[:-step])
        best = np.where(take, right, left)
        span += step
    return at


class Slice:
    """Some documents' words, one after the other: hashes, numbers, each word's document (its place in the lists), documents' starts."""

    def __init__(self, vocabulary: WordNumbers, numbers: list, ids: list, hashes: list, found: list):
        self.numbers = np.concatenate(numbers)
        self.words = np.array(vocabulary.hashes, np.uint64)[self.numbers]
        lengths = np.array(list(map(len, numbers)))
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths
        self.ids, self.th, self.found = np.array(ids, np.int64), np.array(hashes, np.int64), found
        self.vocabulary = vocabulary

    def marked(self) -> np.ndarray:
        """The positions that the runs in found name."""
        out = np.zeros(len(self.words), bool)
        for k, runs in enumerate(self.found):
            for raw in runs:
                for first, last in np.frombuffer(raw, "<i4").reshape(-1, 2).tolist():
                    out[self.starts[k] + first : self.starts[k] + last + 1] = True
        return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    vocabulary, held, n = WordNumbers(), ([], [], [], []), 0
    for batch in batches:
        found = batch.column("found").to_pylist() if "found" in batch.schema.names else [None] * batch.num_rows
        for doc_id, th, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist(), found, strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            if len(words) < MIN_WORDS:
                continue
            for k, v in zip(held, (np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)), doc_id, th, runs), strict=True):
                k.append(v)
            n += len(words)
            if n >= SLICE_WORDS:
                yield Slice(vocabulary, *held)
                held, n = ([], [], [], []), 0
                if len(vocabulary) > 1 << 20:
                    vocabulary = WordNumbers()
    if n:
        yield Slice(vocabulary, *held)


def windows(x: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and each one's anchor."""
    anchor = least_in_window(grams(x.words, RANK_WORDS), SPREAD)
    start = np.arange(max(0, len(x.words) - MIN_WORDS + 1))
    start = start[x.doc[start] == x.doc[start + MIN_WORDS - 1]]
    return start, anchor[start]


def _ranges(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(33)).astype(np.int64) * buckets) >> 31


def _rows_of_runs(doc: np.ndarray, th: np.ndarray, at: np.ndarray, later: bool) -> Iterator[tuple]:
    """A row for each document: doc_id, th, later, runs of consecutive positions as pairs of first and last."""
    if not len(doc):
        return
    order = np.lexsort((at, th, doc))
    doc, th, at = doc[order], th[order], at[order]
    new_doc = np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))
    first = np.flatnonzero(new_doc | np.append(True, np.diff(at) > 1))
    last = np.append(first[1:], len(at)) - 1
    pairs = np.stack([at[first], at[last]], 1).astype("<i4")
    cuts = np.flatnonzero(new_doc[first])
    for s, e in zip(cuts, np.append(cuts[1:], len(first)), strict=True):
        yield int(doc[first[s]]), int(th[first[s]]), later, pairs[s:e].tobytes()


_FIELDS = ("bucket", "keys", "docs", "ths", "places", "doc_id", "th", "later", "runs")
_SCHEMA = "bucket int, keys binary, docs binary, ths binary, places binary, doc_id long, th long, later boolean, runs binary"
_FOUND = "doc_id long, th long, later boolean, runs binary"


def _found_table(rows: list[tuple]) -> pa.Table:
    types = (("doc_id", pa.int64()), ("th", pa.int64()), ("later", pa.bool_()), ("runs", pa.binary()))
    return pa.table({name: pa.array([r[k] for r in rows], t) for k, (name, t) in enumerate(types)})


def _deal(key: np.ndarray, spread: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, buckets: int) -> dict:
    """A chunk's hashed entries. spread: hashes that choose the ranges. Those that it holds more than once have met here; one of them goes to its range too,
    marked, so that other chunks meet it."""
    bucket = _ranges(spread, buckets)
    order = np.lexsort((at, th, doc, bucket, key))
    key, doc, th, at, bucket = key[order], doc[order], th[order], at[order], bucket[order]
    copy = np.append(False, (key[1:] == key[:-1]) & (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1])) if len(key) else np.zeros(0, bool)
    key, doc, th, at, bucket = key[~copy], doc[~copy], th[~copy], at[~copy], bucket[~copy]
    same = np.append(False, (key[1:] == key[:-1]) & (bucket[1:] == bucket[:-1])) if len(key) else np.zeros(0, bool)
    many = np.append(same[1:], False) & ~same if len(key) else same
    rows: dict[str, list] = {k: [] for k in _FIELDS}

    def add(**row) -> None:
        for k in _FIELDS:
            rows[k].append(row.get(k))

    for d, t, later, runs in _rows_of_runs(doc[same | many], th[same | many], at[same | many], False):
        add(doc_id=d, th=t, later=later, runs=runs)
    key, doc, th, at, bucket, many = key[~same], doc[~same], th[~same], at[~same], bucket[~same], many[~same]
    order = np.lexsort((at, th, doc, bucket))  # by place: neighbours compress best
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order)) if len(order) else []
    s = 0
    for e in ends:
        own = order[s:e]
        place = (at[own].astype(np.uint64) << np.uint64(1)) | many[own].astype(np.uint64)
        add(bucket=int(bucket[own[0]]), keys=pack(key[own]), docs=pack(doc[own]), ths=pack(th[own]), places=pack(place))
        s = e
    return rows


def _in_chunks(entries: Iterator[tuple], buckets: int, bits: int, chunk: int) -> Iterator[dict]:
    held, n = [], 0
    for key, *others in entries:
        held.append((key & np.uint64((1 << bits) - 1), *others))
        n += len(key)
        if n >= chunk:
            yield _deal(*map(np.concatenate, zip(*held, strict=True)), buckets)
            held, n = [], 0
    if held:
        yield _deal(*map(np.concatenate, zip(*held, strict=True)), buckets)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The retained suffixes, by their prefixes' hashes."""
    for x in slices(batches):
        _, anchor = windows(x)
        at = np.unique(anchor)
        key = grams(x.words, PREFIX)[at]
        yield key, _mix(key, np.uint64(1)), x.ids[x.doc[at]], x.th[x.doc[at]], at - x.starts[x.doc[at]]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The windows around the suffixes that met another, by their hashes; those of one suffix go to one range, which its prefix chooses."""
    for x in slices(batches):
        start, anchor = windows(x)
        near = x.marked()[anchor]
        start, anchor = start[near], anchor[near]
        yield grams(x.words, MIN_WORDS)[start], _mix(grams(x.words, PREFIX)[anchor], np.uint64(1)), x.ids[x.doc[start]], x.th[x.doc[start]], start - x.starts[x.doc[start]]


def _meet(table: pa.Table) -> pa.Table:
    """Sorts what all chunks sent to a range; entries that share their hash with another have met."""
    key = np.concatenate([np.empty(0, np.uint64), *(unpack(x, "<u8") for x in table["keys"].to_pylist())])
    doc, th = (np.concatenate([np.empty(0, np.int64), *(unpack(x, "<i8") for x in table[k].to_pylist())]) for k in ("docs", "ths"))
    place = np.concatenate([np.empty(0, np.uint64), *(unpack(x, "<u8") for x in table["places"].to_pylist())])
    at, many = (place >> np.uint64(1)).astype(np.int64), (place & np.uint64(1)).astype(bool)
    order = np.lexsort((at, th, doc, key))
    key, doc, th, at, many = key[order], doc[order], th[order], at[order], many[order]
    new = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1])  # a repeated row is no other place
    keep = np.append(np.ones(min(1, len(key)), bool), new)
    key, doc, th, at = key[keep], doc[keep], th[keep], at[keep]
    same = key[1:] == key[:-1]
    met = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
    return _found_table([*_rows_of_runs(doc[met], th[met], at[met], False)])


def _met(entries: DataFrame, buckets: int) -> DataFrame:
    """doc_id, th, found: of each document what met another place, in its chunk or in a range."""
    compared = dealt(entries.where("bucket is not null").select("bucket", "keys", "docs", "ths", "places"), buckets).applyInArrow(_meet, _FOUND)
    met = entries.where("bucket is null").select("doc_id", "th", "later", "runs").unionByName(compared)
    return met.groupBy("doc_id", "th").agg(F.collect_list("runs").alias("found"))


# ---------------------------------------------------------------- the suffix array

_CONTEXTS = "bucket int, n int, words binary, texts binary, docs binary, ths binary, places binary, many binary, doc_id long, th long, later boolean, runs binary"
_CONTEXT_FIELDS = tuple(x.split()[0] for x in _CONTEXTS.split(", "))
BEFORE = SPREAD - 1
WIDTH = BEFORE + MIN_WORDS


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int, chunk: int) -> Iterator[dict]:
    """Retained suffixes with the words around them that lie in marked windows. Equal ones leave a chunk once."""
    held: list[tuple] = []
    vocabulary, n = None, 0

    def flush() -> Iterator[dict]:
        matrix, bucket, doc, th, at = map(np.concatenate, zip(*held, strict=True))
        yield _deal_contexts(matrix, bucket, doc, th, at, list(vocabulary), buckets)

    for x in slices(batches):
        if held and (x.vocabulary is not vocabulary or n >= chunk):
            yield from flush()
            held, n = [], 0
        vocabulary = x.vocabulary
        marked = x.marked()
        start, anchor = windows(x)
        start, anchor = start[marked[start]], anchor[marked[start]]
        if not len(start):
            continue
        at, own = np.unique(anchor, return_inverse=True)
        first, last = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
        np.minimum.at(first, own, start)  # of an anchor's marked windows, the first start and the last
        np.maximum.at(last, own, start)
        bucket = _ranges(_mix(grams(x.words, PREFIX), np.uint64(1))[at], buckets)
        for s in range(0, len(at), chunk):
            e = s + chunk
            place = at[s:e, None] + np.arange(-BEFORE, MIN_WORDS)
            inside = (place >= first[s:e, None]) & (place < last[s:e, None] + MIN_WORDS)
            matrix = np.where(inside, x.numbers[np.clip(place, 0, len(x.numbers) - 1)] + 1, 0).astype(np.int32)
            held.append((matrix, bucket[s:e], x.ids[x.doc[at[s:e]]], x.th[x.doc[at[s:e]]], at[s:e] - x.starts[x.doc[at[s:e]]]))
            n += len(matrix)
            if n >= chunk:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


def _rows_as_bytes(matrix: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings with the same order and equality."""
    plain = np.ascontiguousarray(matrix.astype(">u4"))
    return plain.view(f"S{4 * matrix.shape[1]}").reshape(-1)


def _deal_contexts(matrix: np.ndarray, bucket: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, words: list[bytes], buckets: int) -> dict:
    order = np.lexsort((at, th, doc, _dense(_rows_as_bytes(matrix))))
    matrix, bucket, doc, th, at = matrix[order], bucket[order], doc[order], th[order], at[order]
    equal = np.append(False, (matrix[1:] == matrix[:-1]).all(axis=1))
    copy = equal & np.append(False, (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1]))
    matrix, bucket, doc, th, at, equal = (v[~copy] for v in (matrix, bucket, doc, th, at, equal))
    many = np.append(equal[1:], False) & ~equal
    rows: dict[str, list] = {k: [] for k in _CONTEXT_FIELDS}

    def add(**row) -> None:
        for k in _CONTEXT_FIELDS:
            rows[k].append(row.get(k))

    for d, t, later, runs in _window_rows(matrix, doc, th, at, equal, True):
        add(doc_id=d, th=t, later=later, runs=runs)
    matrix, bucket, doc, th, at, many = (v[~equal] for v in (matrix, bucket, doc, th, at, many))
    order = np.lexsort((at, th, doc, bucket))  # contexts of one text overlap, so they compress well side by side
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
    s = 0
    for e in ends:
        own = order[s:e]
        used, local = np.unique(matrix[own], return_inverse=True)
        spelled = b" ".join(words[k - 1] for k in used.tolist() if k)
        local = (local + (0 if used[0] == 0 else 1)).astype(np.uint32)
        add(bucket=int(bucket[own[0]]), n=len(own), words=zstandard.ZstdCompressor(level=3).compress(spelled), texts=zstandard.ZstdCompressor(level=3).compress(local.astype("<u4").tobytes()), docs=pack(doc[own]), ths=pack(th[own]), places=pack(at[own].astype(np.int64)), many=pack(many[own].astype(np.uint8)))
        s = e
    return rows


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def _offsets(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words each context has before its suffix, and from it on."""
    there = matrix != 0
    return there[:, :BEFORE].sum(axis=1), there[:, BEFORE:].sum(axis=1)


def _window_rows(matrix: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, which: np.ndarray, later: bool) -> Iterator[tuple]:
    """All windows of the contexts in which, as rows of runs."""
    left, right = _offsets(matrix[which])
    d, t, a = doc[which], th[which], at[which]
    docs, ths, starts = [], [], []
    for before in range(SPREAD):
        ok = (left >= before) & (right >= MIN_WORDS - before)
        docs.append(d[ok])
        ths.append(t[ok])
        starts.append(a[ok] - before)
    yield from _rows_of_runs(np.concatenate(docs), np.concatenate(ths), np.concatenate(starts), later)


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """A range of the suffix array: sorted by words, neighbours compared, matches extended to the left."""
    spelled = [zstandard.ZstdDecompressor().decompress(x).split(b" ") if x else [] for x in table["words"].to_pylist()]
    vocabulary = sorted({w for x in spelled for w in x})
    number = {w: k + 1 for k, w in enumerate(vocabulary)}  # in the order of the words, so rows sort as texts do
    parts = []
    for own, raw in zip(spelled, table["texts"].to_pylist(), strict=True):
        of = np.array([0, *(number[w] for w in own)], np.int64)
        parts.append(of[np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4")].reshape(-1, WIDTH))
    matrix = np.concatenate(parts)
    doc, th, at = (np.concatenate([unpack(x, "<i8") for x in table[k].to_pylist()]) for k in ("docs", "ths", "places"))
    many = np.concatenate([unpack(x, "|u1") for x in table["many"].to_pylist()]).astype(bool)
    order = np.argsort(_rows_as_bytes(matrix[:, BEFORE:]), kind="stable")
    matrix, doc, th, at, many = matrix[order], doc[order], th[order], at[order], many[order]
    left, right = _offsets(matrix)
    common = np.cumprod(matrix[1:, BEFORE:] == matrix[:-1, BEFORE:], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)  # neighbours' common prefixes
    back = matrix[:, :BEFORE][:, ::-1]
    by_place = np.lexsort((at, th, doc))
    same_left = np.zeros(len(matrix), np.int64)  # the words before the suffix, as far as they have been read, as a number
    found: dict[bool, list] = {True: [], False: []}
    for before in range(SPREAD):
        if before:
            same_left = _dense(same_left * (len(vocabulary) + 1) + back[:, before - 1])
        run = np.append(0, np.cumsum(common < MIN_WORDS - before))  # neighbours that share enough to the right
        group = run * (int(same_left.max()) + 1) + same_left
        own = by_place[(left[by_place] >= before) & (right[by_place] >= MIN_WORDS - before)]
        own = own[np.argsort(group[own], kind="stable")]
        if not len(own):
            continue
        g, d, t, a = group[own], doc[own], th[own], at[own]
        in_group = np.append(False, g[1:] == g[:-1])
        same_place = in_group & np.append(False, (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (a[1:] == a[:-1]))  # a repeated row
        head = np.flatnonzero(~same_place)
        later = in_group[head]
        shared = np.append(later[1:], False) | np.maximum.reduceat(many[own], head)
        for is_later, mask in ((True, later), (False, shared & ~later)):
            at_ = head[mask]
            found[is_later].append(np.stack([d[at_], t[at_], a[at_] - before]))
    rows = []
    for later, each in found.items():
        if each:
            d, t, a = np.concatenate(each, axis=1)
            rows += _rows_of_runs(d, t, a, later)
    return _found_table(rows)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    def merged(runs: list[tuple[int, int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for first, last in sorted(runs):
            if out and first <= out[-1][1]:
                out[-1][1] = max(out[-1][1], last + MIN_WORDS)
            else:
                out.append([first, last + MIN_WORDS])
        return out

    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "th", "n_repeated_words", "n_removed_words", "repeated", "removed")}
        for doc_id, th, found in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "th", "found")), strict=True):
            runs = [(x["later"], first, last) for x in found for first, last in np.frombuffer(x["runs"], "<i4").reshape(-1, 2).tolist()]
            every, later = merged([r[1:] for r in runs]), merged([r[1:] for r in runs if r[0]])
            spell = lambda spans: ",".join(f"{s}:{e}" for s, e in spans)
            for k, v in zip(out, (None if doc_id == NO_ID else doc_id, th, sum(e - s for s, e in every), sum(e - s for s, e in later), spell(every), spell(later)), strict=True):
                out[k].append(v)
        yield out


def found_repeats(documents: DataFrame, *, hash_bits: int = HASH_BITS, chunk_entries: int = CHUNK_ENTRIES, chunk_contexts: int = CHUNK_CONTEXTS) -> DataFrame:
    """As repeated_passages, with th, the hash that tells texts of one id apart.

    hash_bits: bits of the filters' hashes; with fewer, more is carried to the suffix array, and the result is the same.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    buckets = bucket_count(docs)
    hashed = lambda df, entries: materialize(map_arrow(df, lambda b: _in_chunks(entries(b), buckets, hash_bits, chunk_entries), _SCHEMA))
    near = materialize(docs.join(_met(hashed(docs, _suffixes), buckets), ["doc_id", "th"]))
    marked = _met(hashed(near, _windows), buckets)
    contexts = materialize(map_arrow(near.drop("found").join(marked, ["doc_id", "th"]), lambda b: _contexts(b, buckets, chunk_contexts), _CONTEXTS), drop=near)
    compared = dealt(contexts.where("bucket is not null").drop("doc_id", "th", "later", "runs"), buckets).applyInArrow(_sort_suffixes, _FOUND)
    every = contexts.where("bucket is null").select("doc_id", "th", "later", "runs").unionByName(compared)
    found = every.groupBy("doc_id", "th").agg(F.collect_list(F.struct("later", "runs")).alias("found"))
    return map_arrow(found, _spans, "doc_id long, th long, n_repeated_words long, n_removed_words long, repeated string, removed string")


def repeated_passages(documents: DataFrame, **sizes) -> DataFrame:
    """A row for each document with a repeat: the numbers of words in repeats and in those to be removed, and their spans.

    Spans are start:end in words, end exclusive, joined by commas; removed ones have an earlier occurrence. sizes: as of found_repeats.
    """
    return found_repeats(documents, **sizes).drop("th")


op4 = repeated_passages


def cut_spans(text: str, spans: str) -> str:
    """The text without the words of the spans and the white space behind them."""
    words = word_spans(text)
    out, at = [], 0
    for span in spans.split(","):
        s, e = map(int, span.split(":"))
        out.append(text[at : words[s][0]])
        at = words[e][0] if e < len(words) else len(text)
    return "".join([*out, text[at:]])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The documents without repeats that occur earlier; n_chars follows the text.

    All rows and columns stay; null and short texts stay as they are; repeated rows (same id, same text) stay alike, since they
    count as one document; texts of one id are told apart, and so are those without an id; an empty table stays empty.
    """
    found = found_repeats(documents).where("removed <> ''").select(F.col("doc_id").alias("__cut_id"), F.col("th").alias("__cut_th"), F.col("removed").alias("__cut_spans"))
    same = documents["doc_id"].cast("long").eqNullSafe(found["__cut_id"]) & (F.xxhash64(documents["text"]) == found["__cut_th"])
    joined = documents.join(found, same, "left").drop("__cut_id", "__cut_th")
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("__cut_spans").to_pylist()
            batch = batch.drop_columns(["__cut_spans"])
            texts = batch.column("text").to_pylist()
            new = [t if s is None or t is None else cut_spans(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if s is None or t is None else len(t) for t, s, n in zip(new, spans, columns["n_chars"].to_pylist(), strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return joined.mapInArrow(run, schema)
