"""Parsing and identity expressions over columns; none of them leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as missing, and as true.
MISSING_TEXTS = ("", "nan", "none", "null")
TRUE_TEXTS = ("true", "1", "yes")
PATENT_SUFFIX = "\\A(.+)-[0-9]{4,}\\z"
PLACEHOLDER = "(?i)\\AM[0-9]+\\z"


def clean_text(c: Column) -> Column:
    """Trimmed text; null where it is one of the texts that mean missing (PR29)."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin(*MISSING_TEXTS), text)


def loose_boolean(c: Column) -> Column:
    """True for true, 1 and yes in any case; false for all else, null included (PR3)."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def number(c: Column) -> Column:
    """A finite or infinite double; null for NaN and for text that is no plain decimal number (PR15)."""
    text = F.trim(c.cast("string"))
    plain = text.rlike("\\A[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z")
    parsed = F.when(plain, text.try_cast("double"))
    return F.when(~F.isnan(parsed), parsed)


def first_present(*columns: Column) -> Column:
    """The first value that is neither null nor empty text (PR1, PR2)."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in columns])


def coalesce_duplicate_headers(frame: DataFrame) -> DataFrame:
    """One column for ``name``, ``name.1``, ``name.2``, ...: the first present value of them (PR1)."""
    groups: dict[str, list[str]] = {}
    for column in frame.columns:
        stem, dot, tail = column.rpartition(".")
        groups.setdefault(stem if dot and tail.isdigit() else column, []).append(column)
    quoted = {stem: [F.col(f"`{c}`") for c in names] for stem, names in groups.items()}
    return frame.select(*[(first_present(*cs) if len(cs) > 1 else cs[0]).alias(stem) for stem, cs in quoted.items()])


def parse_list(c: Column) -> Column:
    """A JSON or literal list as array of trimmed non-blank texts; a bare text is a list of one; missing is empty (PR4).

    Literals in single quotes are read as JSON that allows them. Numbers become their text.
    """
    text = F.trim(c.cast("string"))
    listed = F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    bare = F.when(~F.lower(text).isin(*MISSING_TEXTS), F.array(text))
    found = F.when(text.rlike("\\A\\[.*\\]\\z"), F.coalesce(listed, bare)).otherwise(bare)
    trimmed = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def distinct_in_order(items: Column) -> Column:
    """First occurrences of the trimmed, non-blank items (PR5)."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def patent_document_id(route_id: Column) -> Column:
    """The id without its trailing number of four digits or more (PR6)."""
    return F.regexp_replace(route_id, PATENT_SUFFIX, "$1")


def stable_hash(c: Column, length: int = 16) -> Column:
    """The first hex digits of the text's SHA-256 (PR7)."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)


def stable_bucket(c: Column, buckets: int = 10_000) -> Column:
    """The first 12 hex digits of the text's SHA-1, modulo ``buckets``."""
    return F.conv(F.substring(F.sha1(c.cast("string")), 1, 12), 16, 10).cast("bigint") % buckets


def stable_group_split(c: Column) -> Column:
    """train, val or test in 80/10/10 by hash (PR8)."""
    bucket = stable_bucket(c)
    return F.when(bucket < 8000, "train").when(bucket < 9000, "val").otherwise("test")


def content_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as one JSON array of texts, nulls kept apart from empty texts (PR9)."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def normalize_text(c: Column) -> Column:
    """Line ends as LF, blanks at the ends dropped (PR31)."""
    return F.trim(F.regexp_replace(c, "\r\n?", "\n"))


def text_lines(c: Column) -> Column:
    """Trimmed, non-blank lines in order (UN3)."""
    return F.filter(F.transform(F.split(normalize_text(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def instance_step_id(source_route: Column, instance: Column, step: Column, step_index: Column, row: Column) -> Column:
    """A step id under its route instance: the route's prefix is swapped, or a numbered id made (PR30)."""
    prefix = F.concat(source_route, F.lit("::"))
    swapped = F.concat(instance, F.lit("::"), F.substring(step, F.length(prefix) + 1, F.length(step)))
    made = F.format_string("%s::%03d::row::%09d", instance, step_index.cast("int"), row.cast("long"))
    return F.when(F.startswith(step, prefix), swapped).otherwise(made)


def dataset_digest(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest) that depends on the rows' contents but not on their order (PR10).

    Row hashes are summed in two 32-bit parts, so partial aggregation does the work in each task.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(2)]
    return frame.select(*[p.alias(f"p{i}") for i, p in enumerate(part)]).agg(F.count("*").alias("rows"), F.coalesce(F.sum("p0"), F.lit(0)).alias("digest_low"), F.coalesce(F.sum("p1"), F.lit(0)).alias("digest_high"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
