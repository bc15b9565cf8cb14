"""What the operators of this subpackage share: shared storage, words, tokenizers, packed arrays."""

from __future__ import annotations

import atexit
import base64
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: The white space that separates words; every other character belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile("[^ \t-\r]+")
#: Characters at which str.split() splits too, but which are not in SPACE.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str | None) -> list[str]:
    """The words of a text: maximal runs of characters outside SPACE. A null text has none."""
    if not text:
        return []
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points, end exclusive) of each word."""
    return [m.span() for m in _WORD.finditer(text)]


# ---------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests on one machine, one under /tmp."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/itemloom-shared"


_written: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; the folder belongs to the cluster's housekeeping
            return


def materialize(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, and a lost executor costs a re-read.

    drop: a table written before that is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/itemloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if drop is not None and hasattr(drop, "_shared_path"):
        delete(spark, drop._shared_path)
    return out


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's bytes, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Tasks of one stage, at most; further buckets share them. Estimates from here on say that Catalyst knows no size.
MOST_TASKS = 100_000
UNKNOWN_BYTES = 1 << 50


def dealt(df: DataFrame, buckets: int):
    """df grouped by its bucket column, a task for each bucket: both follow the input, not a fixed setting."""
    return df.repartitionById(min(buckets, MOST_TASKS), "bucket").groupBy("bucket")


def bucket_count(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Into how many buckets to deal what comes from df. It grows with the input, so that a bucket doesn't.

    Where Catalyst knows no size, as for rows from the driver or behind some joins, it is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-size // bytes_each)) if size < UNKNOWN_BYTES else least


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            yield pa.RecordBatch.from_arrays([v.cast(x.type) if isinstance(v := columns[x.name], pa.Array) else pa.array(v, type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- packed arrays


def pack(values: np.ndarray) -> bytes:
    """An array of integers, byte planes apart, compressed."""
    plain = np.ascontiguousarray(values)
    planes = plain.view(np.uint8).reshape(-1, plain.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


# ---------------------------------------------------------------- tokenizers


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def rank_encoder(path: str):
    """The tiktoken encoder of a rank file, without special tokens. Kept by each Python worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


#: Characters whose class is the same in every library's Unicode tables.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20b5]")


class JsonEncoder:
    """Ids of a tokenizers file that has a twin of ranks: plain texts go to the faster twin, any other to the file itself.

    The two agree on texts of plain characters without the string of a special token (tests compare them); Unicode
    tables of the two libraries differ elsewhere. The file decides about such strings: as it is read, "<|endoftext|>" in a
    text is one token.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.fast = rank_encoder(ranks_path) if ranks_path else None
        added = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
        self.not_plain = re.compile("|".join([_PLAIN.pattern, *added]))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast and not self.not_plain.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def json_encoder(json_path: str, ranks_path: str | None = None) -> JsonEncoder:
    return JsonEncoder(json_path, ranks_path)
