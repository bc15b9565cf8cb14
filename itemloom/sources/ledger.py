"""A ledger of model calls: what has been answered once is not asked, or paid for, again.

A call is known by a digest of image, media type, prompt and model. Answers stand in a table in the ledger's folder; a run takes
those that are there by an anti-join on digests, and asks for the rest, each different one once. A task writes every answer to a
file of its own as soon as it has it, and looks for that file before it asks: if the task or its executor is lost, the next
attempt finds what was answered before. When all are answered they are appended to the table and the files go. If a run ends
before that, the next one finds the files.

Calls are made by `lanes` tasks, each of which keeps to its share of `rate` calls a second, so the rate holds for all of them
however many executors there are. Speculative execution may ask twice and should be off for such jobs.

Defined results: images of equal content share one call, and each row its answer; null content and failed calls have an error
and are not entered, so the next run asks again; rows with null keys keep their answers; an empty table makes no call.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import delete, hadoop_path, written
from .paths import ArrowFiles, Files, _mapped

_ANSWER = "digest string, response string, error string"


@dataclass(frozen=True)
class Ledger:
    """folder: one that driver and executors share, and that outlives the run. rate: calls a second, over all tasks."""

    folder: str
    model: str = ""
    rate: float | None = None
    lanes: int = 8
    files: Callable[[], Files] = field(default=ArrowFiles)

    @property
    def table(self) -> str:
        return f"{self.folder.rstrip('/')}/answers"

    @property
    def fresh(self) -> str:
        return f"{self.folder.rstrip('/')}/fresh"


def digest(ledger: Ledger, prompt: str, content: str = "content", media_type: str = "media_type"):
    """What a call is known by; null for null content."""
    parts = [F.sha2(F.col(content), 256), F.coalesce(F.col(media_type), F.lit("")), F.sha2(F.lit(prompt).cast("binary"), 256), F.lit(ledger.model)]
    return F.when(F.col(content).isNotNull(), F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256))


def entered(spark, ledger: Ledger) -> DataFrame:
    """digest, response: all that the ledger's table holds."""
    at, files = hadoop_path(spark, ledger.table)
    if not files.exists(at):
        return spark.createDataFrame([], "digest string, response string")
    return spark.read.schema("digest string, response string").parquet(ledger.table).dropDuplicates(["digest"])


def _asked(ledger: Ledger, make_backend, prompt: str):
    from .remote import redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        own, backend = ledger.files(), None
        pause, last = (ledger.lanes / ledger.rate if ledger.rate else 0.0), 0.0
        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                at = f"{ledger.fresh}/{name[:2]}/{name}"
                try:
                    if own.size(at) is not None:  # an earlier attempt has asked
                        yield [(name, json.loads(own.read(at)), None)]
                        continue
                    backend = backend or make_backend()
                    time.sleep(max(0.0, last + pause - time.monotonic()))
                    last = time.monotonic()
                    answer = backend(batch.column(1)[k].as_py(), batch.column(2)[k].as_py() or "image/jpeg", prompt)
                    own.write(at, json.dumps(answer).encode())
                    yield [(name, answer, None)]
                except Exception as x:
                    yield [(name, None, redacted(f"{type(x).__name__}: {x}"))]

    return run


def call_once(images: DataFrame, make_backend, prompt: str, ledger: Ledger, key: str = "path", content: str = "content", media_type: str = "media_type") -> DataFrame:
    """key, response, error, like remote.call_model. The calls that the ledger lacks are made now."""
    spark = images.sparkSession
    named = images.select(F.col(key).alias("key"), digest(ledger, prompt, content, media_type).alias("digest"), F.col(content).alias("content"), F.col(media_type).alias("media_type"))
    known = entered(spark, ledger)
    new = named.where("digest is not null").join(known, "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"), F.first("media_type").alias("media_type"))
    lanes = new.repartition(ledger.lanes, "digest")
    answers = written(_mapped(lanes, _asked(ledger, make_backend, prompt), _ANSWER))
    answers.where("error is null").select("digest", "response").coalesce(ledger.lanes).write.mode("append").parquet(ledger.table)
    delete(spark, ledger.fresh)
    failed = answers.where("error is not null").select("digest", F.col("error").alias("failed"))
    # of its own: in one query Spark takes two reads of the ledger's folder for the same, though it has grown in between
    own = written(entered(spark, ledger).join(named.select("digest"), "digest", "left_semi"))
    out = named.drop("content", "media_type").join(own, "digest", "left").join(failed, "digest", "left")
    error = F.when(F.col("digest").isNull(), F.lit("ValueError: no content, or more than is sent")).otherwise(F.col("failed"))
    return out.select(F.col("key").alias(key), "response", F.when(F.col("response").isNull(), error).alias("error"))
