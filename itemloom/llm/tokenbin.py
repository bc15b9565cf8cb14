"""Token ids as binary training rows: best-fit-decreasing packing with a segment tree over capacities.

One narrow pass and no shuffle: each partition encodes its documents, cuts the overlong ones losslessly and packs a
bounded window of pieces at a time; pieces of bins that are not nearly full go on to the next window. A row out is one
row of the packed id matrix with its cumulative segment lengths and positions that start again at each segment.

Defined results: a null or empty text is a document of the one end id; a text of any length is cut, never shortened;
repeated rows, ties in length and null ids are packed like any other; the string of a special token in a text is that
token, as in the vocabulary file; an empty table gives no rows; further columns
are ignored. Ids of a window and the order of its rows follow from the partition alone, so a task that runs again
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import json_encoder, map_arrow, tokenizer_path
from .packing import cuts

CAPACITY = 2048
# The vocabulary's end-of-text id behind each document. Rows are padded with it too, as the vocabulary has
# no id to spare; n_tokens and the last of cu_seqlens tell where the padding starts.
END_ID = 50256
PAD_ID = 50256
SLACK = 16
#: Tokens that a task holds at most before it packs them (besides one document).
WINDOW_TOKENS = 6 << 20


class CapacityTree:
    """Segment tree over the capacities 0 to n: how many open bins have each; least() finds the smallest one in use that is enough."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, enough: int) -> int | None:
        i = self.base + enough
        if self.count[i]:
            return enough
        while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right neighbour has bins
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.base:
            i *= 2
            if not self.count[i]:
                i += 1
        return i - self.base


def pack_window(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin that has room."""
    tree, open_, bins = CapacityTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = open_[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        room -= lengths[i]
        if room:
            open_.setdefault(room, []).append(b)
            tree.add(room, 1)
    return bins


def _sequences(batches: Iterator[pa.RecordBatch], json_path: str, ranks_path: str | None, capacity: int, end_id: int, pad_id: int) -> Iterator[dict]:
    from pyspark import TaskContext

    encode = json_encoder(json_path, ranks_path)
    part, made, held, tokens = TaskContext.get().partitionId() << 33, 0, [], 0

    def flush(last: bool) -> Iterator[dict]:
        nonlocal made, held, tokens
        full, kept = [], []
        for b in pack_window([len(x[3]) for x in held], capacity):
            (full if last or sum(len(held[i][3]) for i in b) >= capacity - SLACK else kept).append(b)
        if not last and sum(len(held[i][3]) for b in kept for i in b) > WINDOW_TOKENS // 2:
            full, kept = full + kept, []
        for k in range(0, len(full), 512):
            out: dict[str, list] = {n: [] for n in ("sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts")}
            for b in full[k : k + 512]:
                lengths = [len(held[i][3]) for i in b]
                row = np.full(capacity, pad_id, "<u4")
                positions = np.zeros(capacity, "<u4")
                ends = np.cumsum([0, *lengths])
                for i, s, n in zip(b, ends, lengths, strict=False):
                    row[s : s + n] = held[i][3]
                    positions[s : s + n] = np.arange(n)
                for name, value in zip(out, (part + made, int(ends[-1]), row.tobytes(), ends.tolist(), positions.tobytes(), [held[i][0] for i in b], [held[i][1] for i in b], [held[i][2] for i in b]), strict=True):
                    out[name].append(value)
                made += 1
            yield out
        held = [held[i] for b in kept for i in b]
        tokens = sum(len(x[3]) for x in held)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text), np.uint32(end_id))
            held += [(doc_id, k, s, ids[s : s + n]) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            tokens += len(ids)
            if tokens >= WINDOW_TOKENS:
                yield from flush(False)
    if held:
        yield from flush(True)


def packed_sequences(documents: DataFrame, json_path: str, ranks_path: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, ids and position_ids (capacity little-endian unsigned 32-bit
    integers, padded), cu_seqlens (segments' ends from 0), and each segment's doc_id, piece and start in its document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, lambda b: _sequences(b, json_path, ranks_path, capacity, end_id, pad_id), "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, starts array<long>")


def write_packed(sequences: DataFrame, path: str) -> None:
    """The packed rows as a Parquet table: ids and positions stay fixed-width binary, a matrix row each."""
    sequences.write.option("compression", "zstd").parquet(path)


def op10(documents: DataFrame) -> DataFrame:
    """A row for each sequence: its row of the id matrix and of the positions, segments, and checksums of both rows."""
    rows = packed_sequences(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select("sequence_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "starts", "cu_seqlens", "ids", "position_ids", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def unpack_sequences(rows: list[dict]) -> dict[tuple, np.ndarray]:
    """Ids of each (doc_id, piece), from collected rows; for reading back and for tests."""
    out = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        for k, key in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            out[key] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]
    return out
