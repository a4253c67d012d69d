"""Versions of rows: latest state, partial updates, insertion of absent rows, merging and cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.lookup import lookup_join


def latest_version(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest order values of each key; ties go to the row with the largest other values.

    Copies and older versions are combined before the shuffle. Rows with a null key form a group, as in SQL.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.`{c}`").alias(c) for c in df.columns])


def upsert(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the latest value set in each column: a null doesn't overwrite an earlier value."""
    rest = [c for c in df.columns if c not in keys]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*last)


#: Types that a hash aggregate can hold in its buffer; others make Spark sort the table before and after the shuffle.
_IN_PLACE = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def insert_absent(existing: DataFrame, arriving: DataFrame, keys: Sequence[str], row_id: str = "id") -> DataFrame:
    """Existing rows and those arriving rows whose key isn't there; of arriving rows with equal keys, the smallest id."""
    fresh = first_per_key(arriving, keys, row_id)
    return existing.unionByName(fresh.join(existing.select(*keys), list(keys), "left_anti"))


def first_per_key(df: DataFrame, keys: Sequence[str], row_id: str = "id") -> DataFrame:
    """The row with the smallest id of each key; rows of one key and id are copies of each other.

    Columns of fixed size are picked one by one, which a hash aggregate can do; of other types, whole rows.
    """
    rest = [c for c in df.columns if c not in keys]
    if all(t in _IN_PLACE for c, t in df.dtypes if c in rest):
        return df.groupBy(*keys).agg(*[F.min(c).alias(c) if c == row_id else F.min_by(c, row_id).alias(c) for c in rest]).select(*df.columns)
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), row_id).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def repoint(df: DataFrame, merges: DataFrame, column: str, member: str = "member", root: str = "root") -> DataFrame:
    """Replace merged members by their root."""
    pairs = merges.select(F.col(member).alias(column), F.col(root).alias("_root"))
    return lookup_join(df, pairs, [column], "left").withColumn(column, F.coalesce("_root", F.col(column))).select(*df.columns)


def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't among the first column of `gone`; null keys stay."""
    return lookup_join(df, gone.select(F.col(gone.columns[0]).alias(column)).distinct(), [column], "left_anti")


def only_existing(df: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Rows whose parent exists: what a cascade leaves."""
    return lookup_join(df, parents.select(F.col(parents.columns[0]).alias(column)).distinct(), [column], "left_semi")
