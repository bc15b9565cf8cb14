"""Document and image sources, and the dispatch between them.

Files come through Spark's readers (text, binaryFile, image), so any Hadoop path works and listing is distributed; DOCX and
PDF contents are parsed in an Arrow pass over the bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators.parse import empty_ocr, record

# Image suffixes, media types and the size limit.
IMAGE_SUFFIXES = [".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"]
MEDIA_TYPES = {".bmp": "image/bmp", ".gif": "image/gif", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".png": "image/png", ".webp": "image/webp"}
MAX_BYTES = 20 * 1024 * 1024
MODES = ("full", "describe")


def suffix(path: Column | str) -> Column:
    """The lower-case suffix of a path's last part, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.?(\.[^./]+)$", 1))


def is_image_path(path: Column | str) -> Column:
    return suffix(path).isin(IMAGE_SUFFIXES)


def media_type(path: Column | str) -> Column:
    """By suffix; image/jpeg where none is known."""
    out = F
    for k, v in MEDIA_TYPES.items():
        out = out.when(suffix(path) == k, v)
    return out.otherwise("image/jpeg")


def media_type_of(content: Column | str) -> Column:
    """By the first bytes; image/png where they are unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith("FFD8"), "image/jpeg").when(head.startswith("47494638"), "image/gif").when(head.startswith("424D"), "image/bmp")
    return out.when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").otherwise("image/png")


def source_kind(source: Column | str) -> Column:
    """url, rejected (plain http), text, docx, pdf or image."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(s.startswith("https://"), "url").when(s.startswith("http://"), "rejected").when(suffix(s) == ".txt", "text").when(suffix(s) == ".docx", "docx").when(suffix(s) == ".pdf", "pdf").otherwise("image")


def url_allowed(url: Column | str) -> Column:
    """https with a host that is no private, loopback, link-local, reserved or multicast address by its spelling.

    Names are resolved and checked again where they are fetched.
    """
    u = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(u, r"^[Hh][Tt][Tt][Pp][Ss]://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    # Address ranges that are not public.
    inner = r"^(?:localhost|.*\.localhost|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|192\.0\.0\..*|172\.(?:1[6-9]|2[0-9]|3[01])\..*|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\..*|(?:22[4-9]|2[3-5][0-9])\..*|\[.*\])$"
    return F.coalesce((host != "") & ~host.rlike(inner), F.lit(False))


def encoded(content: Column | str, path: Column | str | None = None) -> Column:
    """An image for a remote model: base64 and media type. Bytes without a path count as image/jpeg."""
    return F.struct(F.translate(F.base64(content), "\r\n", "").alias("base64"), (F.lit("image/jpeg") if path is None else media_type(path)).alias("media_type"))


def text_record(text: Column | str) -> Column:
    """The record of a plain text: all of it, its first line as the question, what it holds, confidence 1."""
    t = F.col(text) if isinstance(text, str) else text
    whole = F.coalesce(t, F.lit(""))
    return record(
        empty_ocr(confidence=1.0)
        | {
            "full_text": whole,
            "question_text": extract.first_line(whole),
            "math_expressions": extract.math_expressions(whole),
            "answer_choices": extract.answer_choices(whole),
            "numbers_found": extract.numbers(whole).cast("array<string>"),
            "variables_found": extract.variables(whole),
        }
    )


def existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Those of some paths or patterns under which there is a file; the others are left out, as they would end a read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if found := path.getFileSystem(conf).globStatus(path):
            out += [p] * (len(found) > 0)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, ocr: whole UTF-8 files of any size."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), text_record("value").alias("ocr"))


def read_binaries(spark: SparkSession, path: str | list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, length, content of files up to max_bytes; larger ones come with null content, so that none goes unseen."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image: decoded images; unreadable ones stay, with a height of -1."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select(F.col("image.origin").alias("path"), "image")


# ---------------------------------------------------------------- DOCX and PDF

_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DOCUMENT_SCHEMA = "path string, paragraphs array<string>, rows array<string>, images array<binary>, error string"


def docx_parts(content: bytes) -> tuple[list[str], list[str], list[bytes]]:
    """Paragraphs that aren't blank, table rows with cells joined by " | ", and embedded images (unreadable ones are left out)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_NS}body")
        spell = lambda e: "".join((x.text or "") if x.tag == f"{_NS}t" else "\t" if x.tag == f"{_NS}tab" else "\n" for x in e.iter() if x.tag in (f"{_NS}t", f"{_NS}tab", f"{_NS}br"))
        paragraphs = [t for p in body.findall(f"{_NS}p") if (t := spell(p)).strip()]
        rows = [" | ".join("\n".join(spell(p) for p in c.findall(f"{_NS}p")).strip() for c in r.findall(f"{_NS}tc")) for t in body.findall(f"{_NS}tbl") for r in t.findall(f"{_NS}tr")]
        images = []
        try:
            links = ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))
        except KeyError:
            links = []
        for link in links:
            if "image" in link.get("Type", "") and link.get("TargetMode") != "External":
                try:
                    images.append(z.read("word/" + link.get("Target", "").removeprefix("/word/")))
                except KeyError:
                    continue
        return paragraphs, rows, images


def pdf_parts(content: bytes) -> tuple[list[str], list[str], list[bytes]]:
    """The text of each page that has any, and images, by pdfplumber or pypdf, whichever there is."""
    texts = lambda pages: [t for p in pages if (t := p.extract_text())]
    images = []
    try:
        import pdfplumber
    except ImportError:
        try:
            import pypdf
        except ImportError:
            raise RuntimeError("reading PDF files needs pdfplumber or pypdf, and neither is installed") from None
        pages = list(pypdf.PdfReader(io.BytesIO(content)).pages)
        for page in pages:
            try:
                images += [x.data for x in page.images]
            except Exception:  # an odd encoding: the text still counts
                continue
        return texts(pages), [], images
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for page in pdf.pages:
            for box in page.images:
                try:
                    out = io.BytesIO()
                    page.crop((box["x0"], box["top"], box["x1"], box["bottom"])).to_image(resolution=150).save(out, format="PNG")
                    images.append(out.getvalue())
                except Exception:  # a box outside its page or an odd encoding: the text still counts
                    continue
        return texts(pdf.pages), [], images


def document_parts(files: DataFrame, parse) -> DataFrame:
    """path, paragraphs, rows, images, error from path, content. A file that can't be parsed has an error and no parts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_DOCUMENT_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if content is None:
                        raise ValueError(f"the file is larger than {MAX_BYTES} bytes")
                    p, r, i = parse(content)
                    out.append((path, p, r, i, None))
                except Exception as x:
                    out.append((path, [], [], [], f"{type(x).__name__}: {x}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(run, _DOCUMENT_SCHEMA)


def document_record(parts: DataFrame, paged: bool = False) -> DataFrame:
    """path, ocr, images, error: the record of each parsed document, confidence 0.95.

    The question is the first paragraph, or the first line where paragraphs are whole pages.
    """
    text = F.array_join(F.concat("paragraphs", "rows"), "\n")
    staged = parts.withColumn("__t", text)
    ocr = record(
        empty_ocr(confidence=0.95)
        | {
            "full_text": F.col("__t"),
            "question_text": extract.first_line("__t") if paged else F.coalesce(F.try_element_at("paragraphs", F.lit(1)), F.lit("")),
            "math_expressions": extract.math_expressions("__t"),
            "answer_choices": extract.answer_choices("__t"),
            "data_elements": F.col("rows"),
            "numbers_found": extract.numbers("__t").cast("array<string>"),
            "variables_found": extract.variables("__t"),
        }
    )
    return staged.select("path", ocr.alias("ocr"), "images", "error")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return document_record(document_parts(read_binaries(spark, path), docx_parts))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    return document_record(document_parts(read_binaries(spark, path), pdf_parts), paged=True)


def embedded_images(documents: DataFrame) -> DataFrame:
    """path, seq, content: a row for each embedded image."""
    return documents.select("path", F.posexplode("images").alias("seq", "content"))


def kinds_of(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The paths by kind, as source_kind names them; paths under which there is no file are left out."""
    local = set(existing(spark, [p for p in paths if not re.match("https?://", p)]))
    kinds: dict[str, list[str]] = {}
    for p in paths:
        if p.startswith(("https://", "http://")):
            kinds.setdefault("url" if p.startswith("https://") else "rejected", []).append(p)
        elif p in local:
            found = re.search(r"\.(txt|docx|pdf)$", p.lower())
            kinds.setdefault({"txt": "text"}.get(found[1], found[1]) if found else "image", []).append(p)
    return kinds


def local_records(spark: SparkSession, kinds: dict[str, list[str]]) -> DataFrame:
    """path, ocr, images, error of text, DOCX and PDF files."""
    none = F.array().cast("array<binary>")
    parts = []
    if "text" in kinds:
        texts = spark.read.text(kinds["text"], wholetext=True).select(F.input_file_name().alias("path"), text_record("value").alias("ocr"))
        parts.append(texts.select("path", "ocr", none.alias("images"), F.lit(None).cast("string").alias("error")))
    for kind, parse in (("docx", docx_parts), ("pdf", pdf_parts)):
        if kind in kinds:
            parts.append(document_record(document_parts(read_binaries(spark, kinds[kind]), parse), paged=kind == "pdf"))
    if not parts:
        parts.append(spark.createDataFrame([], "path string").select("path", text_record(F.lit("")).alias("ocr"), none.alias("images"), F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extract_sources(spark: SparkSession, paths: list[str], mode: str = "full") -> DataFrame:
    """path, ocr, error of files of any kind that needs no remote model; remote.extract_any takes images and URLs too.

    Paths that do not exist are left out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kinds = kinds_of(spark, paths)
    if bad := set(kinds) & {"url", "rejected", "image"}:
        raise ValueError(f"no local reader for {sorted(bad)}; use remote.extract_any for images and https URLs")
    return local_records(spark, kinds).select("path", "ocr", "error")
