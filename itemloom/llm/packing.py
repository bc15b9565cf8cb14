"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts the overlong ones and packs its pieces best-fit, longest first. Bins that
are nearly full are final. The others travel up a tree as items of their fill: groups of `fan_in` nodes pack what their
nodes left over, again best-fit, until one node is left. A node passes on at most `pass_on` bins, the emptiest; the
fuller ones are final there, so that no task's input grows with the corpus. No token is lost or moved between documents.

Defined results: a null or empty text is a document of the one end id; texts of any length are cut, none is dropped;
repeated rows and null ids are packed like any other, pieces of one length in the order of their rows; the string of a
special token in a text is that token, as in the vocabulary file; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import json_encoder, map_arrow, materialize, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: A bin with no more room than this is final.
SLACK = 8
FAN_IN = 8
PASS_ON = 100_000
#: Pieces of one partition that are packed at a time, which bounds a task's memory.
WINDOW = 200_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest first, into the fullest bin with room.

    Bins of the same room are kept together; a bit mask of the rooms in use finds the least one that is enough.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        enough = rooms >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room := capacity - fill[b]:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fill, np.int64)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones behind a first one that may be shorter."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], json_path: str, ranks_path: str | None, capacity: int, end_id: int, window: int) -> Iterator[dict]:
    from pyspark import TaskContext

    encode = json_encoder(json_path, ranks_path)
    part, made = TaskContext.get().partitionId() << 33, 0
    held: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}

    def flush() -> dict:
        nonlocal made
        bins, offsets, fill = best_fit_decreasing(np.array(held["length"], np.int64), capacity)
        out = {k: list(v) for k, v in held.items()} | {"bin": part + made + bins, "offset": offsets, "fill": fill[bins]}
        made += len(fill)
        for v in held.values():
            v.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
            for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                for name, value in zip(held, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].data)), strict=True):
                    held[name].append(value)
            if len(held["piece"]) >= window:
                yield flush()
    if held["piece"]:
        yield flush()


def _merge(level: int, fan_in: int, capacity: int, slack: int, pass_on: int, last: bool):
    """Packs what the nodes of a group left over. A row out for each bin in: the bin that it is in now, and where."""

    def run(key: tuple, bins: pa.Table) -> pa.Table:
        own, size = np.array(bins["own"]), np.array(bins["size"])
        order = np.lexsort((own, -size))  # whatever order the rows came in
        to, at, fill = best_fit_decreasing(size[order], capacity)
        open_ = np.argsort(fill, kind="stable")
        final = fill >= capacity - slack
        final[open_[pass_on:]] = True
        new = (np.int64(level) << 58) + (np.int64(key[0].as_py()) << 30) + to
        return pa.table({"own": own[order], "now": new, "at": at, "size": fill[to], "final": (final | last)[to], "node": np.full(len(own), key[0].as_py(), np.int64)})

    return run


def pack_documents(documents: DataFrame, json_path: str, ranks_path: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, fan_in: int = FAN_IN, pass_on: int = PASS_ON, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    documents: doc_id, text. json_path: a tokenizers file; ranks_path: the same vocabulary as ranks, if there is one.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(map_arrow(docs, lambda b: _pieces(b, json_path, ranks_path, capacity, end_id, window), "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"))
    open_ = pieces.where(F.col("fill") < capacity - slack)
    left = open_.groupBy(F.col("bin").alias("own")).agg(F.first("fill").alias("size")).withColumn("node", F.shiftright("own", 33))
    most, count = pieces.agg(F.max(F.shiftright("bin", 33)), F.count(F.lit(1))).first()
    nodes, moved, level = (most or 0) + 1, None, 0
    while nodes > 1 or (not level and count >= window):  # one partition of several windows has bins to merge as well
        level += 1
        last = nodes <= fan_in
        step = left.select("own", "size", F.floor(F.col("node") / fan_in).cast("long").alias("group")).groupBy("group").applyInArrow(_merge(level, fan_in, capacity, slack, pass_on, last), "own long, now long, at long, size long, final boolean, node long")
        step = materialize(step)
        moves = step.select("own", "now", "at")
        if moved is None:
            moved = moves
        else:
            later = moves.select(F.col("own").alias("now"), F.col("now").alias("then"), F.col("at").alias("more"))
            moved = materialize(moved.join(later, "now", "left").select("own", F.coalesce("then", "now").alias("now"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
        left = step.where(~F.col("final")).groupBy(F.col("now").alias("own")).agg(F.first("size").alias("size"), F.first("node").alias("node"))
        nodes = -(-nodes // fan_in)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*names, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moved.withColumnRenamed("own", "bin"), "bin", "left").select(*names, F.coalesce("now", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))


def op9(documents: DataFrame) -> DataFrame:
    """The contract's rows: byte_bpe_50k.json, id 0 behind each document, sequences of 2048."""
    return pack_documents(documents, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
