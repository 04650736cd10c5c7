"""A search service as a Spark data source: spark.read.format("evloom_search").

Options: queries, a JSON array of texts; service, `package.module:name` of a callable (text, most) -> list of dicts that executors can import; most, results
for each query; per_partition, queries of one task. With push=true, filters on `text` reach the source, and queries that they rule out are not asked. Spark keeps what
the filters of a frame left, for that frame: load() anew for each use then. Without it frames may be used again, and all queries are asked.
"""

from __future__ import annotations

import importlib
import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .. import schemas
from .backends import results_of_call


class HttpSearch:
    """A service that takes POSTed JSON (api_key, query, max_results, topic, include_answer) and answers with JSON that has a list `results` of objects with url,
    title, content, published_date and score. key may be empty where the service needs none."""

    def __init__(self, endpoint: str, key: str = "", topic: str = "news", timeout_s: float = 30):
        self.endpoint, self.key, self.topic, self.timeout_s = endpoint, key, topic, timeout_s

    def __call__(self, text: str, most: int) -> list[dict]:
        body = json.dumps({"api_key": self.key, "query": text, "max_results": most, "topic": self.topic, "include_answer": False}).encode()
        request = urllib.request.Request(self.endpoint, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:  # noqa: S310
            return json.load(reply).get("results", [])


def imported(name: str) -> Callable[[str, int], list[dict]]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class Queries(InputPartition):
    def __init__(self, texts: list[str]):
        super().__init__(texts)
        self.texts = texts


class SearchReader(DataSourceReader):
    def __init__(self, options, service: Callable | None):
        self.queries = list(dict.fromkeys(json.loads(options.get("queries", "[]"))))
        self.service, self.name = service, options.get("service")
        self.push = str(options.get("push", "false")).lower() == "true"
        self.most, self.per_partition = int(options.get("most", 10)), int(options.get("per_partition", 1))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names texts; the rest is Spark's to check."""
        for f in filters:
            if not self.push:
                yield f
            elif isinstance(f, EqualTo) and f.attribute == ("text",):
                self.queries = [q for q in self.queries if q == f.value]
            elif isinstance(f, In) and f.attribute == ("text",):
                self.queries = [q for q in self.queries if q in f.value]
            else:
                yield f

    def partitions(self) -> list[Queries]:
        return [Queries(self.queries[i : i + self.per_partition]) for i in range(0, len(self.queries), self.per_partition)] or [Queries([])]

    def read(self, partition: Queries) -> Iterator[tuple]:
        """The results of the partition's queries; a query whose call fails has none."""
        if not partition.texts:
            return
        service = self.service or imported(self.name)
        for q in partition.texts:
            for row in results_of_call(service, q, self.most):
                yield (q, *row)


class SearchSource(DataSource):
    service: Callable | None = None

    @classmethod
    def name(cls) -> str:
        return "evloom_search"

    def schema(self) -> str:
        return f"text string, {schemas.RAW_RESULT}"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options, type(self).service)


def register(spark: SparkSession, service: Callable[[str, int], list[dict]] | None = None) -> None:
    """Makes the format known, and filters reach it. service: a callable instead of the option, which is sent along."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("SearchSource", (SearchSource,), {"service": staticmethod(service) if service else None}))
