"""Sources named by a column of paths, and the ledger of calls."""

import json
import os

import pytest

from itemloom.sources import documents, paths, remote
from itemloom.sources.ledger import Ledger, call_once, entered

from .test_operators import Reader, docx, png_like


def names(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "path string")


def by_name(rows):
    return {r.path.rsplit("/", 1)[1] if "http" not in r.path else r.path: r for r in rows}


def test_records_equal_those_of_the_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" What is 3 + 4?\nB) x é\n")
    (tmp_path / "empty.TXT").write_text("")
    docx(tmp_path / "b.docx")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "big.docx").write_bytes(b"x" * 3000)
    (tmp_path / "d.png").write_bytes(b"\x89PNG")
    (tmp_path / "dir.txt").mkdir()
    given = [str(tmp_path / n) for n in ("a.txt", "empty.TXT", "b.docx", "c.docx", "none.txt", "none.docx", "d.png", "dir.txt", "big.docx")]
    table = names(spark, *given, *given[:2], None, " ", "http://x.org/a.png", "https://x.org/b.png", f"file://{tmp_path}/a.txt")
    parts = paths.opened(paths.found_paths(table), max_bytes=2000)
    got = by_name(paths.records(parts).where("path not like 'file:%'").collect())
    assert set(got) == {"a.txt", "empty.TXT", "b.docx", "c.docx", "d.png", "big.docx", "http://x.org/a.png", "https://x.org/b.png"}
    want = {r.path.rsplit("/", 1)[1]: r.ocr for r in documents.read_texts(spark, str(tmp_path / "a.txt")).union(documents.read_texts(spark, str(tmp_path / "empty.TXT"))).collect()}
    assert got["a.txt"].ocr == want["a.txt"] and got["a.txt"].kind == "text"
    assert got["empty.TXT"].ocr.full_text == "" and got["empty.TXT"].ocr.extraction_confidence == 1
    for n in ("b.docx", "c.docx"):
        r = documents.read_docx(spark, str(tmp_path / n)).first()
        assert got[n].ocr == r.ocr and got[n].images == r.images and got[n].error == r.error
    assert "larger than 2000" in got["big.docx"].error and bytes(got["d.png"].content) == b"\x89PNG" and got["d.png"].ocr is None
    assert got["http://x.org/a.png"].error and got["https://x.org/b.png"].error is None
    local = by_name(paths.extract_paths(table).collect())
    assert local["a.txt"].ocr == want["a.txt"] and "no local reader" in local["d.png"].error and "no local reader" in local["https://x.org/b.png"].error
    assert paths.extract_paths(names(spark)).count() == 0


class Counted(paths.ArrowFiles):
    """Notes each call, and in which process it was made."""

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def note(self, kind):
        with open(f"{self.folder}/{os.getpid()}.{kind}", "a") as f:
            f.write("x")

    def size(self, path):
        self.note("size")
        return super().size(path)

    def read(self, path):
        self.note("read")
        return super().read(path)


def test_many_paths_without_calls_of_the_driver(spark, tmp_path, monkeypatch):
    """10,000 paths of which half exist: executors look once for each and open each once; tasks read like amounts."""
    files, notes = tmp_path / "files", tmp_path / "notes"
    files.mkdir()
    notes.mkdir()
    for k in range(0, 10_000, 2):
        (files / f"{k}.txt").write_text(f"What is {k} + 1?" + "x" * (20_000 if k % 500 == 0 else 0))
    monkeypatch.setattr(documents, "existing", None)
    table = spark.range(10_000).selectExpr(f"concat('{files}/', id, '.txt') as path")
    make = lambda folder=str(notes): Counted(folder)
    found = paths.found_paths(table, files=make)
    parts = paths.opened(found, files=make, each=paths.OPENING * 500)
    got = parts.selectExpr("path", "length(text) as n", "spark_partition_id() as task").collect()
    assert len(got) == 5000 and sum(r.n for r in got) == sum(os.path.getsize(f) for f in files.iterdir())
    tasks = [sum(r.task == t for r in got) for t in {r.task for r in got}]
    assert len(tasks) >= 10 and max(tasks) <= 502
    calls = {k: sum(os.path.getsize(f) for f in notes.glob(f"*.{k}")) for k in ("size", "read")}
    assert calls == {"size": 10_000, "read": 5000} and not list(notes.glob(f"{os.getpid()}.*"))


def test_large_files_go_to_tasks_of_their_own(spark):
    found = spark.createDataFrame([(f"p{k}", "text", 100 if k % 10 else 5_000_000, None) for k in range(100)], "path string, kind string, size long, error string")
    rows = paths.dealt_by_size(found, 5_000_000).selectExpr("spark_partition_id() as task", "size").collect()
    assert len(rows) == 100
    held = [sum(r.size for r in rows if r.task == t) for t in {r.task for r in rows}]
    assert max(held) <= 2 * 5_000_000 and len(held) > 5


def test_any_source_by_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("What is 2 + 2?")
    docx(tmp_path / "b.docx", png_like(b"inside"))
    docx(tmp_path / "c.docx", png_like(b"bad"))
    (tmp_path / "d.png").write_bytes(png_like(b"alone"))
    (tmp_path / "e.jpg").write_bytes(png_like(b"bad"))

    def fetch(url):
        if "private" in url:
            raise ValueError("not public")
        return png_like(b"fetched"), "image/gif"

    given = [str(tmp_path / n) for n in ("a.txt", "b.docx", "c.docx", "d.png", "e.jpg", "none.png")] + ["https://x.org/i", "https://private/i"]
    want = {k: (r.ocr, r.error) for k, r in by_name(remote.extract_any(spark, given, Reader, fetch=fetch).collect()).items()}
    rows = by_name(remote.extract_rows(names(spark, *given, "http://x.org/i"), Reader, fetch=fetch).collect())
    assert rows.pop("http://x.org/i").error and {k: (r.ocr, r.error) for k, r in rows.items()} == want and len(want) == 7
    once = Ledger(str(tmp_path / "ledger"))
    for _ in range(2):
        rows = by_name(remote.extract_rows(names(spark, *given), Reader, fetch=fetch, ledger=once).collect())
        assert {k: (r.ocr, r.error) for k, r in rows.items()} == want
    with pytest.raises(ValueError):
        remote.extract_rows(names(spark, *given), Reader, mode="other")


class Costly:
    """Notes each image that it is asked about. Dies with its process where `dies` says so, once."""

    def __init__(self, folder, dies=None):
        self.folder, self.dies = folder, dies

    def __call__(self, image, media_type, prompt):
        if self.dies and image == self.dies and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            os._exit(1)
        with open(f"{self.folder}/{image.decode()}", "a") as f:
            f.write("x")
        if image == b"refused":
            raise RuntimeError("status 500 for sk-" + "a" * 24)
        return json.dumps({"full_text": image.decode(), "prompt": len(prompt)})


def test_each_call_is_made_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    images = spark.createDataFrame([(k, bytearray(f"i{k % 30}".encode()), None) for k in range(60)] + [(90, None, None), (None, bytearray(b"i1"), None)], "path int, content binary, media_type string")
    book = Ledger(str(tmp_path / "book"), model="m", lanes=3)
    with pytest.raises(Exception):  # noqa: B017  the task is lost with its worker, and the run with it
        call_once(images, lambda: Costly(str(notes), b"i17"), "p", book).collect()
    asked = len(list(notes.iterdir())) - 1
    assert (notes / "died").exists() and entered(spark, book).count() == 0
    for _ in range(2):
        got = call_once(images, lambda: Costly(str(notes), b"i17"), "p", book).collect()
        assert len(got) == 62 and all(json.loads(r.response)["full_text"] == f"i{(r.path if r.path is not None else 1) % 30}" for r in got if r.path != 90)
        assert [r.error for r in got if r.path == 90] == ["ValueError: no content, or more than is sent"]
    assert 0 < asked < 30 and {f.name: f.read_text() for f in notes.iterdir() if f.name != "died"} == {f"i{k}": "x" for k in range(30)}
    more = spark.createDataFrame([(1, bytearray(b"i1"), None), (2, bytearray(b"new"), None), (3, bytearray(b"refused"), None)], "path int, content binary, media_type string")
    for n in (1, 2):  # failures are asked about again
        got = {r.path: r for r in call_once(more, lambda: Costly(str(notes)), "p", book).collect()}
        assert got[3].error == "RuntimeError: status 500 for ***" and got[3].response is None and (notes / "refused").read_text() == "x" * n
    assert (notes / "i1").read_text() == "x" and (notes / "new").read_text() == "x"
    call_once(more.where("path = 1"), lambda: Costly(str(notes)), "another prompt", book).collect()
    assert (notes / "i1").read_text() == "xx"
    assert call_once(more.where("false"), lambda: Costly(str(notes)), "p", book).count() == 0


def test_the_rate_is_shared(spark, tmp_path):
    import time

    notes = tmp_path / "notes"
    notes.mkdir()
    images = spark.createDataFrame([(k, bytearray(f"r{k}".encode()), None) for k in range(24)], "path int, content binary, media_type string")
    start = time.monotonic()
    assert call_once(images, lambda: Costly(str(notes)), "p", Ledger(str(tmp_path / "book"), rate=8.0, lanes=4)).count() == 24
    assert time.monotonic() - start > 24 / 8 * 0.6
