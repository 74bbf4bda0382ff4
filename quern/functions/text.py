"""Text functions on columns. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of a template.
QUERY_MARK, TARGET_MARK = "~QUERYTEXT~", "~TARGETTABLE~"


def namespace_of(name: Column) -> Column:
    """What stands before the first dot; null if there is none."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", 1))


def has_run_prefix(name: Column, prefix: str) -> Column:
    """Two segments exactly, of which the first starts with ``prefix``; false for null."""
    parts = F.split(name, r"\.")
    return F.coalesce((F.size(parts) == 2) & F.get(parts, F.lit(0)).startswith(prefix), F.lit(False))


def render_template(template: Column, query: Column, target: Column) -> Column:
    """Put the query text in first, then the target; a target mark inside the query is replaced too."""
    with_query = F.replace(template, F.lit(QUERY_MARK), F.coalesce(query, F.lit("")))
    return F.replace(with_query, F.lit(TARGET_MARK), F.coalesce(target, F.lit("")))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of a pattern's first match; null where it isn't found."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def joined(*parts: Column) -> Column:
    """Concatenation in which null counts as the empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def split_target(target: Column) -> Column:
    """struct(name, columns, keys) of a target such as ``DB.T ColumnMap(a=x, b=y) KeyColumns(a)``; lists are empty if left out."""

    def items(word: str) -> Column:
        body = F.regexp_extract(target, rf"(?i){word}\s*\(([^)]*)\)", 1)
        return F.when(F.trim(body) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, ","), lambda x: F.trim(x)))

    return F.struct(F.trim(F.regexp_extract(target, r"^([^\s(]+)", 1)).alias("name"), items("ColumnMap").alias("columns"), items("KeyColumns").alias("keys"))
