"""Parsers, images, sources, streams and remote models."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.operators import parse, visual
from itemloom.sources import documents, remote
from itemloom.streaming import items as streams


def frame(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, raw string")


# ---------------------------------------------------------------- parsers


def test_classification(spark):
    raws = ['{"table": true, "array": "false", "primary": "table"}', "no json", "{bad", '{"primary":"zzz"}', '```json\n{"picture": 1, "primary": "text_only"}\n```', '```{"table": true}```', None, '{"table": "", "array": [], "picture": {}, "other": 0.0, "histogram": [1]}']
    got = [r["models"] for r in parse.with_classification(frame(spark, *raws), "raw").orderBy("id").collect()]
    assert [(m.model_count, m.primary) for m in got] == [(2, "table"), (0, "other"), (0, "other"), (0, "other"), (1, "text_only"), (1, "other"), (0, "other"), (1, "other")]
    assert got[0].array and got[7].histogram


def test_ocr(spark):
    raws = ['{"full_text":"hi"}', "plain words 12", '{"image_description": "a line"}', "?!", '{"full_text": null}', '{"content_type": "x", "labels": ["a"], "answer_choices": {"A": "1"}}', None, "{broken 7"]
    got = [r["ocr"] for r in parse.with_ocr(frame(spark, *raws), "raw").orderBy("id").collect()]
    assert [o.content_type for o in got] == ["text_only", "text_only", "image_only", "image_only", "image_only", "x", "image_only", "text_only"]
    assert got[1].extraction_confidence == 0.5 and got[1].numbers_found == ["12.0"] and got[5].answer_choices == {"A": "1"} and got[0].labels is None


def test_merge(spark):
    base = spark.createDataFrame([(1,), (2,)], "doc_id int").select("doc_id", parse.record(parse.empty_ocr(confidence=1.0) | {"labels": F.array(F.lit("z")), "answer_choices": F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2"))}).alias("ocr"))
    images = spark.createDataFrame([(1, 2, "second", 0.9, "B"), (1, 1, "", 0.5, "C")], "doc_id int, seq int, d string, c double, k string")
    images = images.select("doc_id", "seq", parse.record(parse.empty_ocr() | {"image_description": F.col("d"), "extraction_confidence": F.col("c"), "labels": F.array("k"), "answer_choices": F.create_map("k", F.lit("new"))}).alias("ocr"))
    got = {r.doc_id: r.ocr for r in parse.merge_images(base, images).collect()}
    assert got[1].content_type == "mixed" and got[1].image_description == "[Image 2] second" and got[1].extraction_confidence == 0.91
    assert got[1].labels == ["B", "C", "z"] and got[1].answer_choices == {"A": "1", "B": "new", "C": "new"}
    assert got[2].content_type == "text_only" and got[2].extraction_confidence == 1.0


@pytest.mark.parametrize("keys,want", [(["a", "b", "c"], "42"), (["a", "x"], "0"), (["n"], None), (["s", "t"], "0")])
def test_safe_get(spark, keys, want):
    assert frame(spark, '{"a": {"b": {"c": 42}}, "n": null, "s": "x"}').select(parse.safe_get("raw", keys, "0")).first()[0] == want


# ---------------------------------------------------------------- images


def image(pixels):
    pixels = np.asarray(pixels, np.uint8)
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    h, w, n = pixels.shape
    return {"origin": "", "height": h, "width": w, "nChannels": n, "mode": 0, "data": bytearray(pixels.tobytes())}


def test_solid_and_rectangle():
    f = visual.features(np.full((40, 60, 3), 80, np.uint8))
    assert f["pixel_statistics"]["contrast"] == 0 and f["edge_metrics"]["edge_ratio"] == 0 and f["dimensions"]["aspect_ratio"] == 1.5 and f["structural_elements"]["contour_count"] == 0
    p = np.zeros((120, 160, 3), np.uint8)
    p[30:90, 40:120] = 255
    f = visual.features(p)
    assert f["structural_elements"]["shapes"] == {"triangles": 0, "rectangles": 1, "circles": 0, "polygons": 0} and f["structural_elements"]["contour_count"] == 1 and f["edge_metrics"]["edge_pixels"] > 0
    assert f["edge_metrics"]["sobel_max"] == pytest.approx(np.hypot(765, 765), rel=1) and f["frequency_domain"]["low_freq_ratio"] + f["frequency_domain"]["mid_freq_ratio"] + f["frequency_domain"]["high_freq_ratio"] == pytest.approx(1)


def test_shapes_and_lines():
    y, x = np.mgrid[:200, :200]
    disc = np.where((x - 100) ** 2 + (y - 100) ** 2 <= 45**2, 255, 0).astype(np.uint8)
    s = visual.structure(disc)
    assert s["shapes"]["circles"] == 1 and s["circle_count"] == 1
    triangle = np.where((y > 40) & (y < 160) & (np.abs(x - 100) < (y - 40) / 2), 255, 0).astype(np.uint8)
    assert visual.structure(triangle)["shapes"]["triangles"] == 1
    lines = np.zeros((200, 200), np.uint8)
    lines[50:53, 10:190] = 255
    assert visual.line_count(visual.canny(lines, 50, 150)) >= 1
    ring = np.where(np.abs(np.hypot(x - 100, y - 100) - 60) < 5, 255, 0).astype(np.uint8)
    ring[95:105, 95:105] = 255  # inside the ring: no external contour
    assert visual.structure(ring)["contour_count"] == 1


def test_canny_and_filters_by_hand():
    step = np.zeros((9, 9), np.uint8)
    step[:, 5:] = 200
    gx, gy = visual.sobel(step)
    assert gx.max() == 800 and gy.max() == 0 and visual.laplacian(step).min() == -200
    assert visual.canny(step, 50, 150).sum() == 9


def test_image_rows_and_rollup(spark):
    p = np.zeros((64, 64), np.uint8)
    p[10:50, 10:50] = 255
    rows = [(1, 1, image(p)), (2, 1, image(np.zeros((8, 8, 4), np.uint8))), (3, 2, {**image(p), "height": -1, "width": -1}), (4, 2, None)]
    schema = "id int, item_id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    df = spark.createDataFrame(rows, schema)
    flat = visual.image_features(df, "id").select("id", *visual.flat())
    got = {r.id: r for r in flat.collect()}
    assert got[1].visual_total_shapes == 1 and got[2].visual_contrast == 0 and got[2].visual_width == 8 and got[3].visual_total_shapes == 0 and got[3].visual_mean is None and got[4].visual_width is None
    rolled = {r.item_id: r for r in visual.rollup(flat.join(df.select("id", "item_id"), "id")).collect()}
    assert rolled[1].visual_width == 64 and rolled[1].visual_total_shapes == 1 and rolled[1].visual_contrast == 127.5 and rolled[2].visual_total_shapes == 0 and rolled[2].visual_contrast is None


# ---------------------------------------------------------------- sources


def docx(path, image=b"\x89PNG"):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Solve x = 2") + p(" ") + p("A) 1 B) 2") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>"
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/image" Target="media/i.png"/><Relationship Id="r2" Type="http://x/image" Target="media/gone.png"/></Relationships>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/media/i.png", image)


def test_text_and_docx(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" What is 3 + 4?\nB) x\n")
    docx(tmp_path / "b.docx")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    t = documents.read_texts(spark, str(tmp_path / "a.txt")).first()["ocr"]
    assert t.question_text == "What is 3 + 4?" and t.numbers_found == ["3.0", "4.0"] and t.extraction_confidence == 1 and t.full_text.startswith(" What")
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_docx(spark, str(tmp_path / "*.docx")).collect()}
    d = got["b.docx"].ocr
    assert d.full_text == "Solve x = 2\nA) 1 B) 2\na | b" and d.data_elements == ["a | b"] and d.question_text == "Solve x = 2" and d.answer_choices["A"] == "1" and d.extraction_confidence == 0.95 and len(got["b.docx"].images) == 1
    assert "BadZipFile" in got["c.docx"].error
    assert documents.embedded_images(documents.read_docx(spark, str(tmp_path / "b.docx"))).count() == 1
    assert documents.read_pdf(spark, str(tmp_path / "d.pdf")).first().error
    every = documents.extract_sources(spark, [str(tmp_path / n) for n in ("a.txt", "b.docx")])
    assert every.count() == 2
    with pytest.raises(ValueError):
        documents.extract_sources(spark, ["x.txt"], mode="other")
    with pytest.raises(ValueError):
        documents.extract_sources(spark, ["http://x/y.txt"])


def test_kinds_and_urls(spark):
    rows = ["a.TXT", "b.docx", "c.pdf", "d.png", "e", "https://x.org/a.txt", "http://x.org/a.png", "dir.txt/f"]
    got = [r.k for r in frame(spark, *rows).select("id", documents.source_kind("raw").alias("k")).orderBy("id").collect()]
    assert got == ["text", "docx", "pdf", "image", "image", "url", "rejected", "image"]
    assert [r.m for r in frame(spark, "a.tif", "b.PNG", "c").select("id", documents.media_type("raw").alias("m")).orderBy("id").collect()] == ["image/jpeg", "image/png", "image/jpeg"]
    urls = ["https://example.org/x", "http://example.org", "https://", "https://10.1.2.3/x", "https://127.0.0.1:80", "https://[::1]/", "https://172.20.0.1", "https://172.32.0.1", "https://u:p@192.168.0.1/", None, "https://224.0.0.1"]
    got = [r.k for r in frame(spark, *urls).select("id", documents.url_allowed("raw").alias("k")).orderBy("id").collect()]
    assert got == [True, False, False, False, False, False, False, True, False, False, False]


def test_images_from_files(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes([200, 100, 0]) * 5 for _ in range(4))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"junk")
    flat = visual.image_features(documents.read_images(spark, str(tmp_path)), "path").select("path", *visual.flat())
    got = {r.path.rsplit("/", 1)[1]: r for r in flat.collect()}
    assert (got["a.png"].visual_width, got["a.png"].visual_height, got["a.png"].visual_mean) == (5, 4, 100.0) and got["b.png"].visual_width is None


# ---------------------------------------------------------------- remote models


class Stub:
    def __call__(self, image, media_type, prompt):
        if image == b"bad":
            raise RuntimeError("status 500 for key sk-" + "a" * 30)
        return json.dumps({"full_text": image.decode(), "table": True, "primary": "table"})


def test_remote(spark):
    df = spark.createDataFrame([("a", bytearray(b"one"), "image/png"), ("b", bytearray(b"bad"), None)], "path string, content binary, media_type string")
    got = {r.path: r for r in remote.read_images_by_model(df, Stub).collect()}
    assert got["a"].ocr.full_text == "one" and got["a"].error is None and got["b"].ocr is None and got["b"].error == "RuntimeError: status 500 for key ***"
    got = {r.path: r for r in remote.classify_images(df, Stub).collect()}
    assert got["a"].models.table and got["a"].models.primary == "table"
    with pytest.raises(ValueError):
        remote.read_images_by_model(df, Stub, mode="other")
    urls = spark.createDataFrame([("https://x/1",), ("https://x/2",)], "url string")

    def fetch(url):
        if url.endswith("2"):
            raise ValueError("not public")
        return b"\1", "image/png"

    assert {r.url: (r.media_type, r.error) for r in remote.fetch_images(urls, fetch).collect()} == {"https://x/1": ("image/png", None), "https://x/2": (None, "ValueError: not public")}


def test_client_requests(monkeypatch):
    for name in ("GEMINI_API_KEY", "GOOGLE_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(ValueError):
        remote.resolve_key("openai")
    with pytest.raises(ValueError):
        remote.ClientConfig("other")
    monkeypatch.setenv("GOOGLE_API_KEY", "k")
    b = remote.HttpBackend(remote.ClientConfig())
    url, headers, body = b.request(b"x", "image/png", "p")
    assert headers == {"x-goog-api-key": "k"} and body["generationConfig"] == {"temperature": 0.1, "maxOutputTokens": 2048} and "k" not in url.split("/")
    assert b.answer({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    o = remote.HttpBackend(remote.ClientConfig("openai"), "k2")
    assert o.request(b"x", "image/png", "p")[1]["Authorization"] == "Bearer k2" and o.answer({"choices": [{"message": {"content": "c"}}]}) == "c"
    for bad in ("http://x", "https://127.0.0.1/", "https://localhost/"):
        with pytest.raises((ValueError, OSError)):
            remote.fetch_https(bad)


# ---------------------------------------------------------------- streams


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from itemloom.plans.item import text_features
    from itemloom.plans.queries import items

    batch = items(spark, sf_dir).select("item_id", F.col("txt").alias("text"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.item_stream(streams.read_items(spark, str(tmp_path / "in"), files_each=1))
    streams.write_features(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = text_features(batch)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_image_rollup_stream(spark, tmp_path):
    names = ", ".join(f"{n} double" for n in visual.FLAT_FEATURES)
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, at(5), *[1.0] * 11), (1, at(6), *[3.0] * 11)]
    spark.createDataFrame(rows, f"item_id long, ts timestamp, {names}").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, datetime.datetime(2024, 1, 2), *[0.0] * 11)], f"item_id long, ts timestamp, {names}").write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.image_rollup_stream(spark.readStream.schema(f"item_id long, ts timestamp, {names}").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.sql("select * from rolled").collect()
    assert len(r) == 1 and r[0].visual_line_count == 4 and r[0].visual_width == 3 and r[0].visual_contrast == 2


def test_regions_equal_a_flood():
    """8 and 4 neighbours, on noise, spirals and frames; the first pixel in reading order numbers a region."""
    r = np.random.default_rng(5)
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    for mask in (r.random((23, 31)) < 0.5, r.random((40, 7)) < 0.7, spiral, np.ones((3, 4), bool), np.zeros((3, 4), bool), np.eye(9, dtype=bool)):
        for diagonal in (True, False):
            want = np.zeros(mask.shape, int)
            for y, x in zip(*np.nonzero(mask), strict=True):
                if want[y, x]:
                    continue
                todo, n = [(y, x)], y * mask.shape[1] + x + 1
                while todo:
                    a, b = todo.pop()
                    if not (0 <= a < mask.shape[0] and 0 <= b < mask.shape[1]) or not mask[a, b] or want[a, b]:
                        continue
                    want[a, b] = n
                    todo += [(a + c, b + d) for c in (-1, 0, 1) for d in (-1, 0, 1) if diagonal or not c or not d]
            assert (visual.regions(mask, diagonal) == want).all()


def test_large_noise_takes_seconds():
    import time

    noise = np.random.default_rng(1).integers(0, 256, (2048, 2048)).astype(np.uint8)
    start = time.perf_counter()
    mask = noise > 127
    label = visual.regions(mask)
    assert sum(1 for _ in visual.boxes(label)) == len(np.unique(label)) - 1
    visual.outside(mask)
    assert time.perf_counter() - start < 20


def test_missing_paths_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("What is 2 + 2?")
    got = documents.extract_sources(spark, [str(tmp_path / "a.txt"), str(tmp_path / "none.txt"), str(tmp_path / "none.docx")]).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.txt"] and documents.extract_sources(spark, [str(tmp_path / "none.txt")]).count() == 0


def test_replies_without_an_answer():
    gemini = remote.HttpBackend(remote.ClientConfig(provider="gemini", model="models/some-model"), key="k")
    assert "/models/some-model:" in gemini.request(b"x", "image/png", "p")[0]
    assert gemini.answer({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    with pytest.raises(ValueError):
        gemini.answer({"promptFeedback": {"blockReason": "SAFETY"}})


def png_like(text):
    return b"\x89PNG" + text


class Reader:
    def __call__(self, image, media_type, prompt):
        if b"bad" in image:
            raise RuntimeError("unreadable")
        return json.dumps({"full_text": image[4:].decode(), "image_description": media_type, "numbers_found": ["7.0"], "extraction_confidence": 0.5})


def test_one_entry_point_for_any_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("What is 2 + 2?")
    docx(tmp_path / "b.docx", png_like(b"inside"))
    docx(tmp_path / "c.docx", png_like(b"bad"))
    (tmp_path / "d.png").write_bytes(png_like(b"alone"))
    (tmp_path / "e.jpg").write_bytes(png_like(b"bad"))

    def fetch(url):
        if "private" in url:
            raise ValueError("not public")
        return png_like(b"fetched"), "image/gif"

    paths = [str(tmp_path / n) for n in ("a.txt", "b.docx", "c.docx", "d.png", "e.jpg", "none.png")] + ["https://x.org/i", "https://private/i"]
    rows = remote.extract_any(spark, paths, Reader, fetch=fetch).collect()
    got = {r.path.rsplit("/", 1)[1] if "https" not in r.path else r.path: r for r in rows}
    assert len(rows) == len(got) == 7 and {k for k, r in got.items() if r.error} == {"e.jpg", "https://private/i"}
    assert got["a.txt"].ocr.numbers_found == ["2.0", "2.0"] and got["d.png"].ocr.full_text == "alone" and got["https://x.org/i"].ocr.image_description == "image/gif"
    assert got["b.docx"].ocr.content_type == "mixed" and got["b.docx"].ocr.image_description == "[Image 1] image/png" and "7.0" in got["b.docx"].ocr.numbers_found
    assert got["c.docx"].ocr.content_type == "text_only" and got["c.docx"].error is None
    assert remote.extract_any(spark, [], Reader).count() == 0
    with pytest.raises(ValueError):
        remote.extract_any(spark, ["http://x.org/i"], Reader)


def test_pdf_by_either_library(monkeypatch):
    """No PDF library is installed here: stand-ins with the calls that the two offer."""
    import sys
    import types

    class Box:
        data = b"raw"

        def save(self, out, format):
            out.write(b"drawn")

    class Page:
        def __init__(self, text, images):
            self.text, self.images = text, images

        def extract_text(self):
            return self.text

        def crop(self, box):
            if box[0] < 0:
                raise ValueError("outside")
            return types.SimpleNamespace(to_image=lambda resolution: Box())

    class Odd(Page):
        images = property(lambda self: (_ for _ in ()).throw(KeyError("filter")), lambda self, x: None)

    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    pages = [Page("one\ntwo", [Box(), Box()]), Page(None, []), Odd("three", [])]
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(pages=pages)))
    assert documents.pdf_parts(b"") == (["one\ntwo", "three"], [], [b"raw", b"raw"])
    boxes = [{"x0": x, "top": 0, "x1": 1, "bottom": 1} for x in (0, -1)]

    class Open:
        pages = [Page("one", boxes), Page("", [])]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: Open()))
    assert documents.pdf_parts(b"") == (["one"], [], [b"drawn"])


def test_pages_give_their_first_line(spark):
    parts = spark.createDataFrame([("p", ["\n What is 1?\nmore", "next"], [], [], None)], documents._DOCUMENT_SCHEMA)
    r = documents.document_record(parts, paged=True).first().ocr
    assert r.question_text == "What is 1?" and r.full_text.endswith("more\nnext")


def test_fetches_go_to_the_checked_address(monkeypatch):
    import socket

    asked = []

    def lookup(host, port, **_):
        asked.append(host)
        return [(socket.AF_INET, socket.SOCK_STREAM, 6, "", ("93.184.216.34" if len(asked) == 1 else "127.0.0.1", port))]

    def connect(address, timeout):
        asked.append(address)
        raise OSError("stop here")

    monkeypatch.setattr(socket, "getaddrinfo", lookup)
    monkeypatch.setattr(socket, "create_connection", connect)
    with pytest.raises(OSError, match="stop here"):
        remote.fetch_https("https://u:p@x.org/i?q=1")
    assert asked == ["x.org", ("93.184.216.34", 443)]
    with pytest.raises(ValueError, match="not public"):
        remote.fetch_https("https://x.org/i")


def test_passing_trouble_is_tried_again(monkeypatch):
    import urllib.error
    import urllib.request

    codes = [429, 503]

    class Reply:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            return b'{"choices": [{"message": {"content": "c"}}]}'

    def urlopen(call, timeout):
        if codes:
            raise urllib.error.HTTPError("u", codes.pop(0), "m", {}, None)
        return Reply()

    monkeypatch.setattr(urllib.request, "urlopen", urlopen)
    b = remote.HttpBackend(remote.ClientConfig("openai", wait_s=0), "k")
    assert b(b"x", "image/png", "p") == "c" and not codes
    codes[:] = [400]
    with pytest.raises(urllib.error.HTTPError):
        b(b"x", "image/png", "p")
    codes[:] = [500] * 9
    with pytest.raises(urllib.error.HTTPError):
        b(b"x", "image/png", "p")
    assert len(codes) == 5


def test_a_vocabulary_of_several_lengths_splits_texts_once(spark):
    from itemloom.operators import vocabulary

    texts = spark.createDataFrame([(1, "a b a b, a"), (1, "c  d"), (2, "b b b")], "id long, txt string")
    terms = spark.createDataFrame([("a",), ("a b",), ("b b",), ("b a b",)], "term string")
    found = vocabulary.table_matches(texts, "id", "txt", terms)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 3), (1, "a b", 2), (1, "b a b", 1), (2, "b b", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
