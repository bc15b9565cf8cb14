import hashlib
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

from itemloom.llm import bpe, packing, tokenbin
from itemloom.llm.common import json_encoder, pack, rank_encoder, tokenizer_path, unpack

from .cases import documents, texts

RANKS, JSON = tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json")


def test_packed_arrays_round_trip():
    for a in (np.array([], np.uint32), np.arange(1000, dtype=np.uint64) << np.uint64(40), np.array([-1, 5], np.int64)):
        assert (unpack(pack(a), a.dtype.str) == a).all()


def test_bpe_equals_the_library_and_decodes(spark):
    got = sorted(map(tuple, bpe.encode_documents(documents(spark), RANKS).collect()), key=repr)
    enc = rank_encoder(RANKS)
    want = []
    for i, t in texts():
        raw = enc.encode_to_numpy(t or "", disallowed_special=()).astype("<u4").tobytes()
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), bytearray(raw)))
    assert got == sorted(want, key=repr)
    decoded = bpe.decode_documents(bpe.encode_documents(documents(spark), RANKS), RANKS).collect()
    assert sorted(map(repr, map(tuple, decoded))) == sorted(repr((i, t or "")) for i, t in texts())


def test_bpe_of_a_shuffled_input(spark):
    """Whatever the input's plan, the splits and their order: the rows are read once."""
    from pyspark.sql import functions as F

    want = sorted(map(repr, map(tuple, bpe.op2(documents(spark)).collect())))
    for df in (documents(spark).repartition(7), documents(spark).withColumn("r", F.rand()).orderBy("r"), documents(spark).coalesce(1), documents(spark).join(documents(spark).select("doc_id").distinct(), "doc_id", "left")):
        assert sorted(map(repr, map(tuple, bpe.op2(df).collect()))) == want


def test_decoding_joins_odd_ids(spark):
    rows = [(1, np.array([31373], "<u4").tobytes()), (2, b""), (3, None), (4, np.array([10**6], "<u4").tobytes()), (5, np.array([187], "<u4").tobytes()), (1, np.array([31373], "<u4").tobytes())]
    got = bpe.decode_documents(spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in rows], "doc_id long, ids binary"), RANKS).collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id != 5) == [(1, "hello"), (1, "hello"), (2, ""), (3, ""), (4, "")] and len(got) == 6
    assert {r.doc_id: r.text for r in got}[3] is None is {r.doc_id: r.text for r in got}[4] is {r.doc_id: r.text for r in got}[5]


def test_splitter_agrees_on_every_character():
    enc, split = rank_encoder(RANKS), bpe.splitter().findall
    r = random.Random(5)
    for c in [*range(0x3100), *r.sample(range(0x3100, 0xD800), 500), *r.sample(range(0xE000, sys.maxunicode + 1), 1500)]:
        s = f"a{chr(c)}1 {chr(c)}b. {chr(c)}  {chr(c)}"
        assert [i for w in split(s) for i in enc.encode_ordinary(w)] == enc.encode_ordinary(s), hex(c)


def test_twin_vocabularies_agree_on_plain_texts():
    from itemloom.llm.common import _PLAIN

    both = json_encoder(JSON, RANKS)
    r = random.Random(6)
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(JSON)
    plain = [chr(c) for c in range(0x250) if not _PLAIN.search(chr(c))]
    for _ in range(300):
        s = "".join(r.choices(plain + [" ", "\n", "e", "1", "'s", "<|endoftext|>"] * 20, k=40))
        assert both(s).tolist() == untouched.encode(s, add_special_tokens=False).ids
    assert both("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]


def pieces_of(encode, rows, end_id, capacity):
    out = []
    for i, t in rows:
        ids = [*encode(t).tolist(), end_id]
        first = len(ids) % capacity or min(capacity, len(ids))
        for k, s in enumerate([0, *range(first, len(ids), capacity)]):
            part = np.array(ids[s : first if k == 0 else s + capacity], "<u4")
            out.append((i, k, s, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in,partitions", [(8, 3), (2, 9)])
def test_packing_is_whole_and_tight(spark, fan_in, partitions):
    rows = texts() + [(100 + i, t) for i, (_, t) in enumerate(texts() * 6)]
    df = packing.pack_documents(documents(spark, rows).repartition(partitions), JSON, RANKS, capacity=256, slack=4, fan_in=fan_in)
    got = df.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == pieces_of(json_encoder(JSON, RANKS), rows, 0, 256)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * -(-sum(r.length for r in got) // 256) + 1


def test_packing_passes_on_a_bounded_number_of_bins(spark):
    rows = [(i, "a " * 600) for i in range(60)]
    got = packing.pack_documents(documents(spark, rows).repartition(12), JSON, RANKS, capacity=1000, fan_in=2, pass_on=2).collect()
    assert len(got) == 60 and max(r.offset + r.length for r in got) <= 1000


def test_windows_of_one_partition_are_merged(spark):
    """Two documents fill a sequence; windows of three leave one document each, which only the merge puts together."""
    docs = documents(spark, [(i, "a " * 300) for i in range(6)]).coalesce(1)
    size = packing.pack_documents(docs, JSON, RANKS).first().length
    got = packing.pack_documents(docs, JSON, RANKS, capacity=2 * size, window=3).collect()
    assert len(got) == 6 and len({r.sequence_id for r in got}) == 3 and {r.offset for r in got} == {0, size}


def test_best_fit_decreasing_by_hand():
    bins, offsets, fill = packing.best_fit_decreasing(np.array([5, 7, 3, 5, 10]), 10)
    assert fill.tolist() == [10, 10, 10] and offsets[4] == 0 and bins[1] == bins[2]


def test_capacity_tree_equals_a_scan():
    r = random.Random(3)
    tree, counts = tokenbin.CapacityTree(100), [0] * 101
    for _ in range(2000):
        c = r.randrange(101)
        if r.random() < 0.5 and counts[c]:
            counts[c] -= 1
            tree.add(c, -1)
        else:
            counts[c] += 1
            tree.add(c, 1)
        n = r.randrange(101)
        assert tree.least(n) == next((k for k in range(n, 101) if counts[k]), None)
        if r.random() < 0.02:
            for k, v in enumerate(counts):
                tree.add(k, -v)
            counts = [0] * 101


def test_token_rows_round_trip(spark, tmp_path):
    df = tokenbin.packed_sequences(documents(spark), JSON, RANKS, capacity=512)
    tokenbin.write_packed(df, str(tmp_path / "rows"))
    rows = [r.asDict() for r in spark.read.parquet(str(tmp_path / "rows")).collect()]
    got = []
    for r in rows:
        assert len(r["ids"]) == len(r["position_ids"]) == 4 * 512 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 512
        ids, positions = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4")
        assert (ids[r["n_tokens"] :] == tokenbin.PAD_ID).all()
        for k, (i, p, s) in enumerate(zip(r["doc_ids"], r["pieces"], r["starts"], strict=True)):
            a, b = r["cu_seqlens"][k : k + 2]
            assert positions[a:b].tolist() == list(range(b - a))
            got.append((i, p, s, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(got, key=repr) == pieces_of(json_encoder(JSON, RANKS), texts(), tokenbin.END_ID, 512)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.op9(none).count() == tokenbin.op10(none).count() == bpe.op2(none).count() == 0
