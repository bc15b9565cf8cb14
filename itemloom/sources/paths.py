"""Sources named by a column of paths: rows of a table, not a list on the driver.

Executors ask for the files' sizes and open them; the driver makes no call for a single file. Files are dealt out by size, so a
task reads about EACH bytes, whatever the mix of large and small ones. A file that does not exist, or is a folder, is left out
where it is looked for.

Results are those of the readers in documents: text files whole, DOCX and PDF contents parsed, up to MAX_BYTES for all but text.

Defined results: null and blank paths are left out; a path that occurs in several rows is opened once and gives one row; a
file that can't be read, is too large or can't be parsed has an error; https URLs and images are no local texts: they come with
their kind and without a record (images with their content), for remote.extract_rows; plain http has an error; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.charclass import is_blank
from ..operators.parse import empty_ocr, record
from ..storage import written
from .documents import MAX_BYTES, docx_parts, pdf_parts, source_kind

#: Bytes that a task reads, and what opening a file counts for.
EACH, OPENING = 64 << 20, 256 << 10
#: Bytes after which a task passes on what it has read.
HELD = 16 << 20
LOCAL = ("text", "docx", "pdf")
PARSERS = {"docx": docx_parts, "pdf": pdf_parts}


class Files(Protocol):
    """How an executor looks at files. Made there, once for each task."""

    def size(self, path: str) -> int | None: ...

    def read(self, path: str) -> bytes: ...

    def write(self, path: str, content: bytes) -> None: ...


class ArrowFiles:
    """Local paths and the URIs that pyarrow's file systems know (file, s3, gs, hdfs and others)."""

    def __init__(self) -> None:
        self.known: dict = {}

    def at(self, path: str):
        from pyarrow import fs

        plain = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", path))
        root = re.match("[a-z0-9+.-]+://[^/]*", plain)
        if not root:
            return self.known.setdefault("", fs.LocalFileSystem()), plain
        if root[0] not in self.known:
            self.known[root[0]], _ = fs.FileSystem.from_uri(plain)
        system = self.known[root[0]]
        return system, system.normalize_path(plain.split("://", 1)[1] if not plain.startswith(("hdfs:", "viewfs:")) else plain[len(root[0]) :])

    def size(self, path: str) -> int | None:
        from pyarrow import fs

        system, at = self.at(path)
        found = system.get_file_info(at)
        return found.size if found.type == fs.FileType.File else None

    def read(self, path: str) -> bytes:
        system, at = self.at(path)
        with system.open_input_stream(at) as f:
            return f.read()

    def write(self, path: str, content: bytes) -> None:
        """Whole or not at all: a file appears under its name only when it is complete."""
        import uuid

        system, at = self.at(path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as f:
            f.write(content)
        system.move(part, at)


def _mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """mapInArrow for a function that yields lists of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in f(batches):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def found_paths(paths: DataFrame, column: str = "path", files: Callable[[], Files] = ArrowFiles) -> DataFrame:
    """path, kind, size, error: a row for each different path that exists; URLs have size 0. Executors look; a written table."""
    spark = paths.sparkSession
    named = paths.select(F.col(column).cast("string").alias("path")).where(~is_blank("path")).distinct()
    named = named.repartition(4 * spark.sparkContext.defaultParallelism, "path").select("path", source_kind("path").alias("kind"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = files()
        for batch in batches:
            rows = []
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind in ("url", "rejected"):
                    rows.append((path, kind, 0, "only https URLs are fetched" if kind == "rejected" else None))
                    continue
                try:
                    if (size := own.size(path)) is not None:
                        rows.append((path, kind, size, None))
                except Exception as x:
                    rows.append((path, kind, 0, f"{type(x).__name__}: {x}"))
            yield rows

    return written(_mapped(named, look, "path string, kind string, size long, error string"))


def dealt_by_size(found: DataFrame, each: int = EACH) -> DataFrame:
    """The rows in tasks of about `each` bytes, by a running sum over all of them.

    The sum has two steps: over the rows of a bucket, and over the buckets' totals, of which there are as many as tasks.
    """
    weight = F.col("size") + OPENING
    total = found.agg(F.sum(weight)).first()[0] or 0
    buckets = max(1, 4 * found.sparkSession.sparkContext.defaultParallelism)
    rows = found.withColumn("__bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    from pyspark.sql import Window

    inside = F.sum(weight).over(Window.partitionBy("__bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = rows.groupBy("__bucket").agg(F.sum(weight).alias("__sum"))
    before = totals.withColumn("__before", F.sum("__sum").over(Window.orderBy("__bucket")) - F.col("__sum")).drop("__sum")
    at = F.expr(f"cast((__before + __inside - 1) div {each} as int)")
    tasks = rows.withColumn("__inside", inside).join(F.broadcast(before), "__bucket").withColumn("__task", at)
    return tasks.repartitionById(max(1, -(-total // each)), "__task").select(*found.columns)


_PARTS = "path string, kind string, text string, paragraphs array<string>, rows array<string>, images array<binary>, content binary, error string"


def opened(found: DataFrame, files: Callable[[], Files] = ArrowFiles, max_bytes: int = MAX_BYTES, each: int = EACH) -> DataFrame:
    """path, kind, text, paragraphs, rows, images, content, error: what the files hold. Executors open them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own, rows, held = files(), [], 0
        for batch in batches:
            for path, kind, size, error in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text, parts, content = None, ([], [], []), None
                try:
                    if error is None and kind not in ("url", "rejected"):
                        if kind != "text" and size > max_bytes:
                            raise ValueError(f"the file is larger than {max_bytes} bytes")
                        content = own.read(path)
                        held += len(content)
                        if kind == "text":
                            text, content = content.decode("utf-8", "replace"), None
                        elif kind in PARSERS:
                            parts, content = PARSERS[kind](content), None
                except Exception as x:
                    text, parts, content, error = None, ([], [], []), None, f"{type(x).__name__}: {x}"
                rows.append((path, kind, text, *parts, content, error))
                if held >= HELD:
                    yield rows
                    rows, held = [], 0
        yield rows

    return _mapped(dealt_by_size(found.select("path", "kind", "size", "error"), each), read, _PARTS)


def _record(text: Column) -> Column:
    """The record of a text, DOCX or PDF file from its parts and its whole text."""
    is_text, is_docx = F.col("kind") == "text", F.col("kind") == "docx"
    first = F.coalesce(F.try_element_at("paragraphs", F.lit(1)), F.lit(""))
    return record(
        empty_ocr()
        | {
            "full_text": text,
            "question_text": F.when(is_docx, first).otherwise(extract.first_line(text)),
            "math_expressions": extract.math_expressions(text),
            "answer_choices": extract.answer_choices(text),
            "data_elements": F.col("rows"),
            "numbers_found": extract.numbers(text).cast("array<string>"),
            "variables_found": extract.variables(text),
            "extraction_confidence": F.when(is_text, 1.0).otherwise(0.95),
        }
    )


def records(parts: DataFrame) -> DataFrame:
    """path, kind, ocr, images, content, error of opened files; ocr is null for images, URLs and files with an error of reading."""
    whole = F.when(F.col("kind") == "text", F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.concat("paragraphs", "rows"), "\n"))
    staged = parts.withColumn("__t", whole)
    ocr = F.when(F.col("kind").isin(*LOCAL) & ((F.col("kind") != "text") | F.col("error").isNull()), _record(F.col("__t")))
    return staged.select("path", "kind", ocr.alias("ocr"), "images", "content", "error")


def extract_paths(paths: DataFrame, column: str = "path", files: Callable[[], Files] = ArrowFiles) -> DataFrame:
    """path, kind, ocr, error of the text, DOCX and PDF files that a column names. Other kinds that exist have an error."""
    found = records(opened(found_paths(paths, column, files), files))
    other = F.when(~F.col("kind").isin(*LOCAL), F.concat(F.lit("no local reader for "), F.col("kind")))
    return found.select("path", "kind", "ocr", F.coalesce("error", other).alias("error"))


def write_texts(rows: DataFrame, path: str, text: str, files: Callable[[], Files] = ArrowFiles) -> DataFrame:
    """Writes each row's text to the file that its path names, and returns the paths with the bytes written. Null texts make no file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own = files()
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name is not None and content is not None:
                    own.write(name, content.encode())
                    done.append((name, len(content.encode())))
            yield done

    return written(_mapped(rows.select(path, text), put, "path string, bytes long"))
