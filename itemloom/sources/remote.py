"""Remote vision models behind a small protocol. Nothing is called unless a backend is given.

A backend is made once for each partition, on the executor, where it also finds its key; keys are never in a plan. A call
that fails gives a row with an error, secrets cut out of its message.
"""

from __future__ import annotations

import base64
import http.client
import ipaddress
import json
import os
import re
import socket
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import SECRETS
from ..functions.vocab import MODEL_NAMES
from ..operators.parse import merge_images, with_classification, with_ocr
from .documents import MAX_BYTES, MODES, embedded_images, kinds_of, local_records, media_type, media_type_of, read_binaries
from .ledger import Ledger, call_once
from .paths import LOCAL, ArrowFiles, Files, found_paths, opened, records

TIMEOUT_S = 120
MAX_TOKENS = 2048
TEMPERATURE = 0.1
#: Replies after which a call is made again: too many calls, or a server's passing trouble.
PASSING = {429, 500, 502, 503, 504}

# Providers, with default model and the environment variables of their keys.
PROVIDERS = {"gemini": ("gemini-2.0-flash", ("GEMINI_API_KEY", "GOOGLE_API_KEY")), "openai": ("gpt-4o", ("OPENAI_API_KEY",))}

PROMPTS = {
    "full": "Read this image of a mathematics item. Answer with one JSON object and nothing else. Its keys: content_type (text_only, image_only or mixed), full_text, image_description, question_text, math_expressions (list of strings), answer_choices (object from letter to text), data_elements, labels, numbers_found, variables_found (lists of strings), extraction_confidence (0 to 1).",
    "describe": "Describe what this image shows to somebody who solves the item, in at most {max_words} words. Answer with one JSON object with the keys content_type, full_text (all text in the image) and image_description.",
    "classify": "Which kinds of mathematical visual does this image hold? Answer with one JSON object: a boolean for each of " + ", ".join(MODEL_NAMES) + ", and primary, the name of the main one.",
}


class VisionBackend(Protocol):
    def __call__(self, image: bytes, media_type: str, prompt: str) -> str: ...


@dataclass(frozen=True)
class ClientConfig:
    provider: str = "gemini"
    model: str | None = None
    timeout_s: int = TIMEOUT_S
    attempts: int = 4
    wait_s: float = 1.0  # before the second attempt, doubled before each further one

    def __post_init__(self) -> None:
        if self.provider not in PROVIDERS:
            raise ValueError(f"provider is one of {', '.join(PROVIDERS)}")

    @property
    def model_name(self) -> str:
        return self.model or PROVIDERS[self.provider][0]


def resolve_key(provider: str, key: str | None = None) -> str:
    """The argument, else the environment of the process that asks."""
    for found in (key, *(os.environ.get(n) for n in PROVIDERS[provider][1])):
        if found:
            return found
    raise ValueError(f"no key for {provider}: set {' or '.join(PROVIDERS[provider][1])}")


def redacted(message: str) -> str:
    return re.sub(SECRETS, "***", message)


class HttpBackend:
    """Calls a provider's HTTP interface. Make it inside a backend factory, so that it and its key live on the executor."""

    def __init__(self, config: ClientConfig, key: str | None = None):
        self.config, self.key = config, resolve_key(config.provider, key)

    def request(self, image: bytes, media_type: str, prompt: str) -> tuple[str, dict, dict]:
        data, model = base64.b64encode(image).decode(), self.config.model_name.removeprefix("models/")
        if self.config.provider == "gemini":
            body = {"contents": [{"role": "user", "parts": [{"text": prompt}, {"inline_data": {"mime_type": media_type, "data": data}}]}], "generationConfig": {"temperature": TEMPERATURE, "maxOutputTokens": MAX_TOKENS}}
            return f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", {"x-goog-api-key": self.key}, body
        body = {"model": model, "temperature": TEMPERATURE, "max_tokens": MAX_TOKENS, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{media_type};base64,{data}"}}]}]}
        return "https://api.openai.com/v1/chat/completions", {"Authorization": f"Bearer {self.key}"}, body

    def answer(self, reply: dict) -> str:
        """The text of a reply; one without candidates, as for a blocked image, is an error and no empty text."""
        if self.config.provider == "gemini":
            if not reply.get("candidates"):
                raise ValueError("the reply holds no candidates")
            return "".join(p.get("text", "") for p in reply["candidates"][0].get("content", {}).get("parts", []))
        return (reply.get("choices") or [{}])[0].get("message", {}).get("content") or ""

    def __call__(self, image: bytes, media_type: str, prompt: str) -> str:
        url, headers, body = self.request(image, media_type, prompt)
        call = urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        for k in range(self.config.attempts):
            try:
                with urllib.request.urlopen(call, timeout=self.config.timeout_s) as r:
                    return self.answer(json.loads(r.read()))
            except urllib.error.HTTPError as x:
                if x.code not in PASSING or k + 1 == self.config.attempts:
                    raise
            time.sleep(self.config.wait_s * 2**k)
        raise ValueError("attempts is at least 1")


def call_model(images: DataFrame, make_backend: Callable[[], VisionBackend], prompt: str, key: str = "path", content: str = "content", media_type: str = "media_type") -> DataFrame:
    """key, response, error: the model's answer for each image."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([images.schema[key], StructField("response", StringType()), StructField("error", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make_backend()
        for batch in batches:
            answers, errors = [], []
            for image, kind in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):  # an image at a time
                try:
                    if not image.is_valid:
                        raise ValueError("no content, or more than is sent")
                    answers.append(backend(image.as_py(), kind or "image/jpeg", prompt))
                    errors.append(None)
                except Exception as x:
                    answers.append(None)
                    errors.append(redacted(f"{type(x).__name__}: {x}"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(answers, pa.string()), pa.array(errors, pa.string())], schema=arrow)

    return images.select(key, content, media_type).mapInArrow(run, schema)


def called(images: DataFrame, make_backend: Callable[[], VisionBackend], prompt: str, key: str, ledger: Ledger | None) -> DataFrame:
    """key, response, error; through a ledger each call is made once, whatever runs and tasks end before their time."""
    return call_model(images, make_backend, prompt, key) if ledger is None else call_once(images, make_backend, prompt, ledger, key)


def read_images_by_model(images: DataFrame, make_backend: Callable[[], VisionBackend], mode: str = "full", max_words: int = 30, key: str = "path", ledger: Ledger | None = None) -> DataFrame:
    """key, ocr, error. Rows with an error have a null record; drop them with where("error is null")."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    found = with_ocr(called(images, make_backend, PROMPTS[mode].replace("{max_words}", str(max_words)), key, ledger), "response")
    return found.select(key, F.when(F.col("error").isNull(), F.col("ocr")).alias("ocr"), "error")


def classify_images(images: DataFrame, make_backend: Callable[[], VisionBackend], key: str = "path", ledger: Ledger | None = None) -> DataFrame:
    """key, models, error."""
    found = with_classification(called(images, make_backend, PROMPTS["classify"], key, ledger), "response")
    return found.select(key, F.when(F.col("error").isNull(), F.col("models")).alias("models"), "error")


# ---------------------------------------------------------------- https images


def resolve_public(host: str, port: int = 443) -> str:
    """An address of a name. ValueError if the name stands for any address that isn't public."""
    found = [x[4][0].split("%")[0] for x in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)]
    for ip in map(ipaddress.ip_address, found):
        if ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified:
            raise ValueError(f"{host} resolves to {ip}, which is not public")
    return found[0]


class Connection(http.client.HTTPSConnection):
    """Connects to the address that was checked, whatever the name resolves to later; the certificate is the name's."""

    def __init__(self, host: str, port: int, timeout_s: int):
        super().__init__(host, port, timeout=timeout_s, context=ssl.create_default_context())
        self.address = resolve_public(host, port)

    def connect(self) -> None:
        plain = socket.create_connection((self.address, self.port), self.timeout)
        self.sock = self._context.wrap_socket(plain, server_hostname=self.host)


def fetch_https(url: str, timeout_s: int = TIMEOUT_S) -> tuple[bytes, str]:
    """The bytes and media type of an https image: public hosts only, no redirects, 20 MB at most."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme != "https" or not parts.hostname:
        raise ValueError("only https URLs with a host are fetched")
    connection = Connection(parts.hostname, parts.port or 443, timeout_s)
    try:
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
        r = connection.getresponse()
        if r.status != 200:
            raise ValueError(f"status {r.status}")
        body = r.read(MAX_BYTES + 1)
        kind = (r.headers.get("content-type") or "").split(";")[0].strip()
    finally:
        connection.close()
    if len(body) > MAX_BYTES:
        raise ValueError(f"the image is larger than {MAX_BYTES} bytes")
    return body, kind if kind.startswith("image/") else "image/jpeg"


def fetch_images(urls: DataFrame, fetch: Callable[[str], tuple[bytes, str]], key: str = "url") -> DataFrame:
    """key, content, media_type, error. fetch: fetch_https, or a stand-in."""
    schema = f"{key} string, content binary, media_type string, error string"
    names = [key, "content", "media_type", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                try:
                    rows.append((url, *fetch(url), None))
                except Exception as x:
                    rows.append((url, None, None, redacted(f"{type(x).__name__}: {x}")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.string(), pa.string()), strict=True)], names=names)

    return urls.select(key).mapInArrow(run, schema)


def fetching(make_backend: Callable[[], VisionBackend], fetch: Callable[[str], tuple[bytes, str]]) -> Callable[[], VisionBackend]:
    """A backend whose images are URLs, fetched where they are asked about, so that no task holds more than one."""

    def make() -> VisionBackend:
        backend = make_backend()

        def ask(url: bytes, _: str, prompt: str) -> str:
            return backend(*fetch(url.decode()), prompt)

        return ask

    return make


def extract_any(spark: SparkSession, paths: list[str], make_backend: Callable[[], VisionBackend], mode: str = "full", max_words: int = 30, fetch: Callable[[str], tuple[bytes, str]] = fetch_https) -> DataFrame:
    """path, ocr, error of sources of any kind: text, DOCX, PDF and image files, https URLs of images.

    Images inside documents are read by the model too and merged into their document's record; those that it can't read are
    left out. Paths that do not exist are left out; plain http is an error. The model is asked when the result is read.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kinds = kinds_of(spark, paths)
    if "rejected" in kinds:
        raise ValueError("only https URLs are fetched")
    read = lambda images, key="path": read_images_by_model(images, make_backend, mode, max_words, key)
    documents = local_records(spark, kinds)
    own = embedded_images(documents).select(F.struct("path", "seq").alias("at"), "content", media_type_of("content").alias("media_type"))
    seen = read(own, "at").where("error is null").select("at.path", "at.seq", "ocr")
    out = merge_images(documents.select("path", "ocr", "error"), seen, "path").select("path", "ocr", "error")
    if "image" in kinds:
        files = read_binaries(spark, kinds["image"]).select("path", "content", media_type("path").alias("media_type"))
        out = out.unionByName(read(files))
    if "url" in kinds:
        urls = spark.createDataFrame([(u,) for u in kinds["url"]], "path string").select("path", F.col("path").cast("binary").alias("content"), F.lit("").alias("media_type"))
        out = out.unionByName(read_images_by_model(urls, fetching(make_backend, fetch), mode, max_words))
    return out


def extract_rows(paths: DataFrame, make_backend: Callable[[], VisionBackend], column: str = "path", mode: str = "full", max_words: int = 30, fetch: Callable[[str], tuple[bytes, str]] = fetch_https, files: Callable[[], Files] = ArrowFiles, ledger: Ledger | None = None) -> DataFrame:
    """path, ocr, error like extract_any, of sources that a table's column names: executors look for the files and open them.

    A row for each different path that exists; plain http is an error of its row.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    read = lambda images, backend=make_backend, key="path": read_images_by_model(images, backend, mode, max_words, key, ledger)
    found = found_paths(paths, column, files)
    documents = records(opened(found.where(F.col("kind").isin(*LOCAL)), files))
    own = embedded_images(documents).select(F.struct("path", "seq").alias("at"), "content", media_type_of("content").alias("media_type"))
    seen = read(own, key="at").where("error is null").select("at.path", "at.seq", "ocr")
    out = merge_images(documents.select("path", "ocr", "error"), seen, "path").select("path", "ocr", "error")
    images = opened(found.where("kind = 'image'"), files).select("path", "content", media_type("path").alias("media_type"), "error")
    asked = read(images.where("error is null"))
    urls = found.where("kind = 'url'").select("path", F.col("path").cast("binary").alias("content"), F.lit("").alias("media_type"))
    none = F.lit(None).cast(out.schema["ocr"].dataType)
    bad = images.where("error is not null").select("path", none.alias("ocr"), "error").unionByName(found.where("kind = 'rejected'").select("path", none.alias("ocr"), "error"))
    return out.unionByName(asked).unionByName(read(urls, fetching(make_backend, fetch))).unionByName(bad)
