"""Pages from the web: a data source, and a step that sends a table of requests.

``spark.read.format("http_pages").option("urls", "a b")``; options: ``urls`` (parted by white space), ``method`` get or
post, ``params`` (URL-encoded), ``headers`` (a JSON object), ``timeout`` in seconds, ``retries``, ``partitions``.
Redirects are followed; ``url`` is the final address. An address that can't be read gives a row with ``error`` and no
markup; answers of status 429 and 5xx and lost connections are tried again after a pause that doubles.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagweave.sources.files import charset_of_content_type, decode

SCHEMA = "requested string, url string, html string, charset string, status int, error string"
_ARROW = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.string()) for f in SCHEMA.split(", ")])
PAUSE = 0.5


def fetch(url: str, method: str = "get", params: str = "", timeout: float = 30.0, headers: dict[str, str] | None = None, retries: int = 2) -> tuple:
    """(address asked for, final address, html, character set, status, error)."""
    body, target = None, url
    if method == "post":
        body = params.encode()
    elif params:
        target = url + ("&" if "?" in url else "?") + params
    status, error = None, None
    for turn in range(retries + 1):
        try:
            request = urllib.request.Request(target, data=body, method=method.upper(), headers=headers or {})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                text, charset = decode(answer.read(), charset_of_content_type(answer.headers.get("Content-Type")))
                return url, answer.geturl(), text, charset, answer.status, None
        except urllib.error.HTTPError as e:
            status, error = e.code, f"HTTP {e.code} {e.reason}"
            if e.code != 429 and e.code < 500:
                break
        except (OSError, ValueError) as e:
            status, error = None, str(e)
            if isinstance(e, ValueError):
                break
        if turn < retries:
            time.sleep(PAUSE * 2**turn)
    return url, target, None, None, status, error


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        urls = self.options.get("urls", "").split()
        n = max(1, min(len(urls), int(self.options.get("partitions", 8))))
        return [_Part(urls[k::n]) for k in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        o = self.options
        for url in partition.urls:
            yield fetch(url, o.get("method", "get").lower(), o.get("params", ""), float(o.get("timeout", 30)), json.loads(o.get("headers", "{}")), int(o.get("retries", 2)))


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpPages)


def send(requests: DataFrame, timeout: float = 30.0, headers: dict[str, str] | None = None, retries: int = 2) -> DataFrame:
    """The answers to requests (url, method, params), as those of ``form_requests``; one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, method, params in zip(*(batch.column(c).to_pylist() for c in ("url", "method", "params")), strict=True):
                row = fetch(url, (method or "get").lower(), params or "", timeout, headers, retries)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    return requests.select("url", "method", "params").mapInArrow(run, SCHEMA)
