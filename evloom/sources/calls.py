"""Calls to the outside world, made once: a table of what was asked and answered, from which every branch of a plan reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.config import ExtractConfig
from . import backends

#: Requests of a task, as long as there are no more than MOST_TASKS. A task that is lost is asked again as a whole, so this bounds what a lost
#: executor costs.
PER_TASK, MOST_TASKS = 64, 20_000
_OWN: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where both are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="evloom-calls-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        named = _OWN[0]
    return f"{named}/evloom-evidence/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what made it runs once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class CallTable:
    """(key, answer columns) at a path: each key is asked once, whatever reads the answers and however often.

    ask() asks for the keys that the table lacks and waits for the answers; what it returns is a scan. A task's answers are in the table as
    soon as the task is over, also if the job fails later, and are not asked again; a failed call is an answer too, where the caller makes it a row.
    Keys that are null are not asked. One driver may write at a time.
    """

    def __init__(self, spark: SparkSession, schema: str, key: str = "key", path: str | None = None, per_task: int = PER_TASK):
        self.spark, self.schema, self.key, self.per_task = spark, schema, key, per_task
        self.path = path or shared_folder(spark, "calls")
        self._make()

    def _make(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def answers(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def ask(self, requests: DataFrame, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The answers of requests' keys; call gets one row for each new key, dealt into tasks of per_task keys."""
        asked = requests.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        new = asked.join(self.answers().select(self.key), self.key, "left_anti")
        # the requests themselves are a table, so that counting and dealing them doesn't run what made them again
        path = f"{self.path}-requests-{uuid.uuid4().hex}"
        new.write.parquet(path)
        new = self.spark.read.schema(new.schema).parquet(path)
        tasks = min(-(-new.count() // self.per_task), MOST_TASKS)
        if tasks:
            rows = call(new.repartition(tasks, self.key))
            columns = self.answers().columns
            rows.select(*columns).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)
        delete(self.spark, path)
        return self.answers().join(requests.select(self.key).distinct(), self.key, "left_semi")

    def delete(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# ---------------------------------------------------------------- the three kinds of calls


def fetch_once(requests: DataFrame, table: CallTable | None = None, cfg: ExtractConfig = ExtractConfig(), fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """FETCH_RESULT rows for requests (url), each url fetched once: by fetch_http, or by another function of a frame with url."""
    table = table or CallTable(requests.sparkSession, schemas.FETCH_RESULT, "url")
    return table.ask(requests.select("url"), fetch or (lambda new: backends.fetch_http(new, cfg)))


class OnceModel:
    """A ModelClient that asks another one once for each key; a prompt that gets no reply is asked again next time."""

    def __init__(self, model: backends.ModelClient, table: CallTable):
        self.model, self.table = model, table

    def complete(self, prompts: DataFrame) -> DataFrame:
        return self.table.ask(prompts, lambda new: backends.with_reply_columns(self.model.complete(new)))


def once(model: backends.ModelClient, spark: SparkSession, table: CallTable | None = None) -> backends.ModelClient:
    """The model, made to be asked once; recorded replies, and a model that is so already, as they are."""
    if getattr(model, "recorded", False) or isinstance(model, OnceModel):
        return model
    return OnceModel(model, table or CallTable(spark, schemas.REPLY))


class OnceBackend:
    """A SearchBackend that asks another one once for each cache key. A query without a result leaves a row without a url, so that it isn't
    asked again either."""

    def __init__(self, backend: backends.SearchBackend, table: CallTable):
        self.backend, self.table, self.name = backend, table, backend.name

    def search(self, queries: DataFrame) -> DataFrame:
        def call(new: DataFrame) -> DataFrame:
            if hasattr(self.backend, "answers"):
                return self.backend.answers(new)
            return new.select("cache_key").join(self.backend.search(new), "cache_key", "left")

        return self.table.ask(queries.select("cache_key", "text"), call).filter("url is not null")


def once_backend(backend: backends.SearchBackend, spark: SparkSession, table: CallTable | None = None) -> backends.SearchBackend:
    if getattr(backend, "recorded", False) or isinstance(backend, OnceBackend):
        return backend
    return OnceBackend(backend, table or CallTable(spark, f"cache_key string, {schemas.RAW_RESULT}", "cache_key"))
