"""String functions of the engine as native columns; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \\t\\n\\f\\r"


def normalise_whitespace(text: Column) -> Column:
    """Runs of white space, no-break spaces too, as one space; invisible signs dropped."""
    return F.regexp_replace(F.regexp_replace(text, f"[{SPACE}\\u00a0]+", " "), "[\\u200b\\u00ad]", "")


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(text.rlike(f"^[{SPACE}]*$"), F.lit(True))


def is_numeric(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))


def is_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike("^[\\x00-\\x7f]*$"), F.lit(True))


def padding(width: Column, most: int = 30) -> Column:
    return F.repeat(F.lit(" "), F.least(width, F.lit(most)) if most >= 0 else width)


def escape_text(text: Column) -> Column:
    """For element content."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_attribute(text: Column) -> Column:
    """For quoted attribute values."""
    out = text
    for a, b in (("&", "&amp;"), ('"', "&quot;"), (" ", "&nbsp;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def attr(name: str, attrs: str = "attrs") -> Column:
    """Value of an attribute in any case, the first one; "" if it has no value, null if it is not there."""
    found = F.filter(attrs, lambda a: F.lower(a["name"]) == name.lower())
    return F.when(F.size(found) > 0, F.coalesce(F.get(found, F.lit(0))["value"], F.lit("")))


def has_attr(name: str, attrs: str = "attrs") -> Column:
    return F.exists(attrs, lambda a: F.lower(a["name"]) == name.lower())


def dataset(attrs: str = "attrs") -> Column:
    """Map of the ``data-`` attributes without the prefix."""
    own = F.filter(attrs, lambda a: F.startswith(a["name"], F.lit("data-")) & (F.length(a["name"]) > 5))
    return F.map_from_entries(F.transform(own, lambda a: F.struct(F.substring(a["name"], 6, 1 << 30).alias("key"), F.coalesce(a["value"], F.lit("")).alias("value"))))


def class_names(value: Column) -> Column:
    """Different class names of a class attribute, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(value, F.lit("")), f"[{SPACE}]+"), lambda c: c != ""))


def strip_leading_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+", "")


def is_absolute_url(text: Column) -> Column:
    """Longer than two signs and with a colon."""
    return F.coalesce((F.length(text) > 2) & text.contains(":"), F.lit(False))


def attrs_of(**pairs: str | None) -> Column:
    """A list of attributes as the nodes have it."""
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).cast("string").alias("value")) for k, v in pairs.items()])


def index_of_key(name: str, attrs: str = "attrs", any_case: bool = False) -> Column:
    """The place of an attribute from 0; -1 if it is not there."""
    keys = F.transform(attrs, lambda a: F.lower(a["name"]) if any_case else a["name"])
    return (F.array_position(keys, name.lower() if any_case else name) - 1).cast("int")


def put_attr(name: str, value: Column, attrs: str = "attrs", any_case: bool = False) -> Column:
    """The attributes with one set: in its place if it is there, else at the end."""
    at, new = index_of_key(name, attrs, any_case), F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    return F.when(at < 0, F.array_append(F.col(attrs), new)).otherwise(F.transform(attrs, lambda a, k: F.when(k == at, new).otherwise(a)))


def remove_attr(name: str, attrs: str = "attrs", any_case: bool = False) -> Column:
    return F.filter(attrs, lambda a: (F.lower(a["name"]) != name.lower()) if any_case else (a["name"] != name))


def add_all_attrs(attrs: str, others: str) -> Column:
    """The attributes with those of another list set."""
    kept = F.transform(attrs, lambda a: F.coalesce(F.get(F.filter(others, lambda b: b["name"] == a["name"]), F.lit(0)), a))
    return F.concat(kept, F.filter(others, lambda b: ~F.exists(attrs, lambda a: a["name"] == b["name"])))


def fold_keys(attrs: str = "attrs") -> Column:
    """The attributes with their names in lower case."""
    return F.transform(attrs, lambda a: F.struct(F.lower(a["name"]).alias("name"), a["value"].alias("value")))


def distinct_keys(attrs: str = "attrs", any_case: bool = False) -> Column:
    """The first attribute of each name."""
    key = (lambda a: F.lower(a["name"])) if any_case else (lambda a: a["name"])
    return F.aggregate(attrs, F.slice(F.col(attrs), 1, 0), lambda acc, a: F.when(F.exists(acc, lambda b: key(b) == key(a)), acc).otherwise(F.array_append(acc, a)))


def same_attrs(a: str, b: str) -> Column:
    """Whether two lists have the same names and values, in any order."""
    return F.array_sort(F.col(a)) == F.array_sort(F.col(b))


def attrs_html(attrs: str = "attrs") -> Column:
    """The attributes as they stand in a tag; those without a value by their names."""
    return F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a["name"], F.when(a["value"].isNull(), "").otherwise(F.concat(F.lit('="'), escape_attribute(a["value"]), F.lit('"'))))), "")


def joined(values: Column, separator: str) -> Column:
    """Strings of an array put together; nulls are left out."""
    return F.array_join(values, separator)


def starts_with_newline(text: Column) -> Column:
    return F.coalesce(text.startswith("\n") | text.startswith("\r\n"), F.lit(False))
