"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Documents are dealt out in chunks, as compressed texts, by a hash of their content (and of the partition they come from, so that repeated rows don't
   make a chunk hot). Both later reads take the same shuffled rows, and a chunk's words are numbered in the same way in
   whatever order its rows come, so it doesn't matter how the input could be read again.
2. Each chunk is split into pre-tokens. Its distinct words get local numbers, the most frequent first, and are dealt out by a
   hash of the word, a row for each chunk and bucket. A bucket holds every chunk's copy of a word, so each distinct word of
   the whole corpus is encoded once.
3. The ids go back to their chunks, which are split again (their words get the same numbers) and put together by position.
   Decoding joins the ids with the token-byte table, as large as the vocabulary file: ids are dense, so a chunk's join is a
   gather from the table's column. decode_documents joins tables of ids.

A word comes once from each chunk, however often the chunk holds it, so frequent words make no hot key. The number of
buckets, and of tasks for them, follows the input's size; chunks are bounded by CHUNK_CHARS and one document.

To split twice costs less disk than to store sequences of word numbers.

Defined results: a null text counts as empty: no tokens, digests of no bytes; texts of any length are encoded whole; strings of
special tokens are ordinary text; repeated rows give equal rows; null ids stay null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_TASKS, bucket_count, dealt, map_arrow, pack, rank_encoder, read_ranks, tokenizer_path, unpack

#: Characters and documents that a chunk is meant for; hashes deal them out evenly.
CHUNK_CHARS = 8 << 20
CHUNK_DOCUMENTS = 1 << 17
#: Bytes of text that a task holds before it compresses them.
HELD_BYTES = 64 << 20


@lru_cache(maxsize=1)
def splitter():
    """The pattern of the rank files. White space is spelled out: the regex library's class holds a few control characters more."""
    import public_tokenizers
    import regex

    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    pattern = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s+", f"[{space}]+")
    return regex.compile(pattern)


class Numbers(dict):
    """Words to numbers in order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Step 1: some documents of one chunk in a row, compressed."""
    held: dict[int, tuple[list, list]] = {}
    chars = 0

    def flush() -> dict:
        rows: dict[str, list] = {k: [] for k in ("chunk", "doc_ids", "sizes", "texts")}
        for chunk, (ids, raw) in held.items():
            for k, v in zip(rows, (chunk, ids, pack(np.array(list(map(len, raw)), np.uint64)), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))), strict=True):
                rows[k].append(v)
        held.clear()
        return rows

    for batch in batches:
        for chunk, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("chunk", "doc_id", "text")), strict=True):
            ids, raw = held.setdefault(chunk, ([], []))
            ids.append(doc_id)
            raw.append((text or "").encode())
            chars += len(raw[-1]) + 64
            if chars >= HELD_BYTES:
                yield flush()
                chars = 0
    if held:
        yield flush()


def _texts(chunk: pa.Table) -> list[str]:
    out = []
    for sizes, texts in zip(chunk["sizes"].to_pylist(), chunk["texts"].to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(texts)
        ends = np.cumsum(unpack(sizes, "<u8"), dtype=np.int64).tolist()
        out += [raw[s:e].decode() for s, e in zip([0, *ends], ends, strict=False)]
    return out


def _numbered(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A chunk's distinct words, the most frequent first, its documents as numbers one after the other, and their lengths."""
    split, numbers = splitter().findall, Numbers()
    sequences = [np.fromiter(map(numbers.__getitem__, split(t)), np.uint32) if t else np.empty(0, np.uint32) for t in texts]
    flat = np.concatenate([np.empty(0, np.uint32), *sequences])
    words = [w.encode() for w in numbers]
    uses = np.bincount(flat, minlength=len(words)).tolist()
    order = sorted(range(len(words)), key=lambda i: (-uses[i], words[i]))
    local = np.empty(len(words), np.uint32)
    local[order] = np.arange(len(words), dtype=np.uint32)
    return [words[i] for i in order], local[flat], np.array(list(map(len, sequences)), np.int64)


def _words(buckets: int):
    """Step 2: of a chunk, a row for each bucket; words in the order of their numbers."""

    def run(key: tuple, chunk: pa.Table) -> pa.Table:
        words, _, _ = _numbered(_texts(chunk))
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        rows = []
        for s, e in zip([0, *ends], ends, strict=False):
            own = order[s:e]
            spelled = [words[i] for i in own]
            rows.append((int(bucket[own[0]]), key[0].as_py(), pack(np.diff(own.astype(np.uint32), prepend=np.uint32(0))), pack(np.array(list(map(len, spelled)), np.uint32)), zstandard.ZstdCompressor(level=3).compress(b"".join(spelled))))
        types = (("bucket", pa.int32()), ("chunk", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()))
        return pa.table({name: pa.array([x[k] for x in rows], t) for k, (name, t) in enumerate(types)})

    return run


def _encode_bucket(ranks_path: str):
    def run(bucket: pa.Table) -> pa.Table:
        encode = rank_encoder(ranks_path).encode_ordinary
        distinct = Numbers()
        uses = []
        for lengths, words in zip(bucket["lengths"].to_pylist(), bucket["words"].to_pylist(), strict=True):
            ends = np.cumsum(unpack(lengths, "<u4")).tolist()
            raw = zstandard.ZstdDecompressor().decompress(words) if ends[-1] else b""
            uses.append(np.fromiter((distinct[raw[s:e]] for s, e in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
        ids = [encode(w.decode()) for w in distinct]  # each distinct word once
        count = np.array(list(map(len, ids)), np.int64)
        flat = np.array([i for x in ids for i in x], np.uint32)
        start = np.cumsum(count) - count
        rows = [(pack(count[u].astype(np.uint32)), pack(flat[ragged(start[u], count[u])])) for u in uses]
        return pa.table({"chunk": bucket["chunk"], "numbers": bucket["numbers"], "lengths": pa.array([r[0] for r in rows], pa.binary()), "ids": pa.array([r[1] for r in rows], pa.binary())})

    return run


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of the slices start to start + count, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def _assemble(ranks_path: str, with_ids: bool):
    def run(chunk: pa.Table, encoded: pa.Table) -> pa.Table:
        table = token_bytes(ranks_path)
        distinct, words, lengths = _numbered(_texts(chunk))
        start, count, flat, at = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), [np.empty(0, np.uint32)], 0
        for numbers, n, ids in zip(*(encoded[k].to_pylist() for k in ("numbers", "lengths", "ids")), strict=True):
            own = np.cumsum(unpack(numbers, "<u4"), dtype=np.int64)
            n = unpack(n, "<u4").astype(np.int64)
            flat.append(unpack(ids, "<u4"))
            start[own], count[own] = at + np.cumsum(n) - n, n
            at += len(flat[-1])
        flat = np.concatenate(flat)
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        at = 0
        for doc_id, n in zip((i for ids in chunk["doc_ids"].to_pylist() for i in ids), lengths.tolist(), strict=True):
            own = words[at : at + n]
            at += n
            ids = flat[ragged(start[own], count[own])]
            raw = ids.astype("<u4").tobytes()
            for k, v in zip(out, (doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(ids, table)).hexdigest(), raw if with_ids else None), strict=True):
                out[k].append(v)
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "ids_sha256": out["ids_sha256"], "decoded_sha256": out["decoded_sha256"], **({"ids": pa.array(out["ids"], pa.binary())} if with_ids else {})})

    return run


@lru_cache(maxsize=2)
def token_bytes(ranks_path: str) -> pa.Array:
    """The token-byte table as a column: the bytes of each id."""
    ranks = read_ranks(ranks_path)
    by_id = {i: raw for raw, i in ranks.items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())


def decode(ids: np.ndarray, table: pa.Array) -> memoryview | bytes:
    """Joins the ids with the table; the bytes that are met lie one after the other."""
    if not len(ids):
        return b""
    met = table.take(pa.array(ids))
    ends = np.frombuffer(met.buffers()[1], np.int64)[[met.offset, met.offset + len(met)]]
    return memoryview(met.buffers()[2])[ends[0] : ends[1]]


def encode_documents(documents: DataFrame, ranks_path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as little-endian unsigned 32-bit integers."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(docs)
    rows, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    cores = documents.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, min(cores, rows), -(-(chars or 0) // CHUNK_CHARS), -(-rows // CHUNK_DOCUMENTS))
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)).cast("int").alias("chunk")
    rows = map_arrow(docs.select(chunk, "doc_id", "text"), _packed, "chunk int, doc_ids array<long>, sizes binary, texts binary")
    dealt_docs = rows.repartitionById(min(chunks, MOST_TASKS), "chunk")
    words = dealt_docs.groupBy("chunk").applyInArrow(_words(buckets), "bucket int, chunk int, numbers binary, lengths binary, words binary")
    encoded = dealt(words, buckets).applyInArrow(_encode_bucket(ranks_path), "chunk int, numbers binary, lengths binary, ids binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return dealt_docs.groupBy("chunk").cogroup(encoded.repartitionById(min(chunks, MOST_TASKS), "chunk").groupBy("chunk")).applyInArrow(_assemble(ranks_path, with_ids), schema)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for key, raw in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<u4")
            for s in range(0, len(ids), 1 << 16):
                part = ids[s : s + (1 << 16)]
                yield {"key": [key] * len(part), "at": np.arange(s, s + len(part)), "id": part.astype(np.int64)}


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded text (null where the bytes are no UTF-8, or an id is unknown), from rows with doc_id and ids.

    Each distinct sequence of ids is taken apart by position, joined with the token-byte table (broadcast: it has one row for each
    entry of the vocabulary file) and put together again. Null ids of a row give a null text.
    """
    spark = encoded.sparkSession
    rows = encoded.select("doc_id", "ids", F.sha2("ids", 256).alias("key"))
    table = spark.createDataFrame([(i, raw.hex()) for raw, i in read_ranks(ranks_path).items()], "id long, hex string")
    apart = map_arrow(rows.where("ids is not null").dropDuplicates(["key"]).select("key", "ids"), _positions, "key string, at long, id long")
    met = apart.join(F.broadcast(table), "id", "left")
    whole = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "hex"))).alias("tokens"), F.bool_or(F.col("hex").isNull()).alias("unknown"))
    raw = F.unhex(F.array_join(F.transform("tokens", lambda x: x["hex"]), ""))
    text = F.when(F.col("unknown"), None).otherwise(F.expr("try_validate_utf8(cast(raw as string))"))
    decoded = whole.select("key", "unknown", raw.alias("raw")).select("key", text.alias("text"))
    nothing = F.when(F.octet_length("ids") == 0, "")
    return rows.join(decoded, "key", "left").select("doc_id", F.coalesce("text", nothing).alias("text"))


def op2(documents: DataFrame) -> DataFrame:
    return encode_documents(documents, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=False)
