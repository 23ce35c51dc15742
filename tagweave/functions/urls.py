"""URL and entity functions: one Arrow batch at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagweave.markup import tags as T
from tagweave.markup import scripts, urls


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, rel: pd.Series) -> pd.Series:
    """Absolute URL of ``rel`` against ``base``; "" if there is none, null for a null ``rel``."""
    return pd.Series([None if r is None else urls.resolve(b, r) for b, r in zip(base, rel, strict=True)])


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded."""
    return text.map(lambda t: None if t is None else T.unescape(t))


@F.pandas_udf(StringType())
def unpack_script(text: pd.Series) -> pd.Series:
    """The source of packed scripts; others as they are."""
    return text.map(lambda t: None if t is None else scripts.unpack(t))


@F.pandas_udf(StringType())
def css_escape(text: pd.Series) -> pd.Series:
    """Names as CSS identifiers."""
    return text.map(lambda t: None if t is None else scripts.css_escape(t))
