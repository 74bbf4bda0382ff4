"""Loading: many queries into one target, insert if absent, column maps."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What ``rows`` adds to ``target``: one row a key, none whose key is there. Null keys never match and always join, as with a unique index."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    keyed = rows.where(whole).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return keyed.select(*rows.columns).unionByName(rows.where(~whole))


def mapped(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``columns`` as target=source pairs (or plain names) make the target's columns; key columns come first."""
    pairs = [tuple(x.strip() for x in c.split("=", 1)) if "=" in c else (c.strip(), c.strip()) for c in columns]
    first = [p for p in pairs if p[0] in (keys or [])]
    return df.select(*[F.col(s).alias(t) for t, s in [*first, *[p for p in pairs if p not in first]]])


def evolved(target: DataFrame, rows: DataFrame, action: str = "process") -> DataFrame:
    """``target`` and ``rows`` together where ``rows`` have columns that ``target`` hasn't.

    ``process`` adds them to the target, null in its old rows; ``ignore`` leaves them out;
    ``halt`` is an error. Columns that only the target has are null in ``rows``.
    """
    new = [c for c in rows.columns if c not in target.columns]
    if new and action == "halt":
        raise ValueError(f"the source has new columns: {', '.join(new)}")
    if action not in ("process", "ignore", "halt"):
        raise ValueError(f"no such action: {action}")
    return target.unionByName(rows.drop(*new) if action == "ignore" else rows, allowMissingColumns=True)
