"""Pages from files of bytes: the character set is told by mark, declaration or default."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Byte order marks and the character sets that they tell; longer ones first.
MARKS = ((codecs.BOM_UTF32_BE, "UTF-32BE"), (codecs.BOM_UTF32_LE, "UTF-32LE"), (codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_BE, "UTF-16BE"), (codecs.BOM_UTF16_LE, "UTF-16LE"))

_CONTENT_TYPE = re.compile(r"charset\s*=\s*[\"']?\s*([^\s,;\"']*)", re.I)
_META = re.compile(rb"<meta\b[^>]*>", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", re.I)
_XML = re.compile(rb"^\s*<\?xml[^>]*?encoding\s*=\s*[\"']([^\"']+)[\"']", re.I)


def validated(name: str | None) -> str | None:
    """A character set's name if it is known."""
    try:
        return codecs.lookup((name or "").strip().strip("\"'")) and name.strip().strip("\"'") if name and name.strip() else None
    except (LookupError, ValueError):
        return None


def charset_of_content_type(content_type: str | None) -> str | None:
    m = _CONTENT_TYPE.search(content_type or "")
    return validated(m[1].replace("charset=", "")) if m else None


def detect_charset(data: bytes, given: str | None = None, default: str = "UTF-8") -> tuple[str, int]:
    """(character set, bytes of the mark): mark, else given, else meta tag, else XML declaration, else default."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, len(mark)
    if known := validated(given):
        return known, 0
    for tag in _META.findall(data):
        if (m := _CHARSET.search(tag)) and (known := validated(m[1].decode("latin-1"))):
            return known, 0
    if (m := _XML.match(data)) and (known := validated(m[1].decode("latin-1"))):
        return known, 0
    return default, 0


def decode(data: bytes, given: str | None = None) -> tuple[str, str]:
    """(text, character set); bytes that it hasn't become U+FFFD."""
    name, skip = detect_charset(data, given)
    return data[skip:].decode(name, "replace"), name


class _Decode:
    SCHEMA = pa.schema([("url", pa.string()), ("html", pa.string()), ("charset", pa.string())])

    def __init__(self, given: str | None):
        self.given = given

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(d or b"", self.given) for d in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([t for t, _ in found]), pa.array([c for _, c in found])], schema=self.SCHEMA)


def decode_pages(raw: DataFrame, charset: str | None = None) -> DataFrame:
    """url, html, charset of rows (path, content); works on batch and streaming frames."""
    return raw.select("path", "content").mapInArrow(_Decode(charset), "url string, html string, charset string")


def read_html_files(spark: SparkSession, path: str, charset: str | None = None, glob: str = "*") -> DataFrame:
    """Pages of a folder of HTML or XML files."""
    return decode_pages(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path), charset)
