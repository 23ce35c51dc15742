"""Streams of pages. Parsing keeps no state between pages, so every page operator runs on a stream as it
is; state is needed only for what counts over pages, which is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.urls import resolve_url
from tagweave.operators import pages as P
from tagweave.sources.files import decode_pages


def read_page_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Pages (page_id, url, html) from a folder that Parquet files are put into."""
    schema = "page_id bigint, url string, html string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def read_file_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Pages from a folder that HTML files are put into."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return decode_pages(raw)


def links(pages: DataFrame, css: str = "a[href]") -> DataFrame:
    """Links of a batch or a stream of pages, absolute, one row each."""
    href = F.get(F.filter("attrs", lambda a: a["name"] == "href"), F.lit(0))["value"]
    return P.select_pages(pages, css).select("page_id", "ord", "text", resolve_url("base_uri", href).alias("href"))


def counts_by_window(found: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of a stream counted by a column and time window; rows later than ``late`` are left out."""
    return found.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"))


def first_seen(found: DataFrame, at: str, by: str, late: str = "2 hours") -> DataFrame:
    """Rows of a stream with the first of each value of a column; a value counts as new again once the watermark
    has passed it, so that state stays bounded."""
    return found.withWatermark(at, late).dropDuplicatesWithinWatermark([by])
