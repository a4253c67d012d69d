"""Joins of a large side with a lookup side whose keys may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import written

#: Size of the rows, as they are held in memory, up to which a lookup side is broadcast.
BROADCAST_BYTES = 8 << 20
#: Bytes that a row takes beside its values: its place in the hash relation and the row's header.
ROW_BYTES = 48
#: Types whose values take at most eight bytes.
_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
#: Plan nodes that cost no more than reading the rows.
_PLAIN = {"Project", "Filter", "LogicalRelation", "Relation", "LocalRelation", "Range", "LogicalRDD", "DataSourceV2Relation", "DataSourceV2ScanRelation"}


def fits_broadcast(df: DataFrame, size: int = BROADCAST_BYTES) -> bool:
    """Whether the rows take at most `size` bytes in memory. Reads no more rows than could fit, and one."""
    variable = [F.col(f"`{c}`") for c, t in df.dtypes if t not in _FIXED]
    length = F.octet_length(F.to_json(F.struct(*variable))) if variable else F.lit(0)
    row = ROW_BYTES + 8 * len(df.columns)
    n, total = df.limit(size // row + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(length.cast("long")), F.lit(0))).first()
    return n * row + total <= size


def both(first: Column, second: Column, compat: bool = False) -> Column:
    """Conjunction of two conditions; with `compat`, only the first, as a lookup that loses its second condition."""
    return first if compat else first & second


def _is_read(df: DataFrame) -> bool:
    """Whether the rows are only read, filtered and projected, so that measuring them first costs little."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in _PLAIN:
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def lookup_join(large: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", size: int = BROADCAST_BYTES) -> DataFrame:
    """Join `large` with `lookup` on equal `on`; `how` is inner, left, left_semi or left_anti.

    The lookup side is measured: up to `size` bytes of whole rows it is broadcast, so the large side isn't shuffled. One
    that must be computed is written to the shared folder first, so that it is computed once. A larger one is joined by
    sort and merge, which rules a broadcast by the size of its files out; a partition that a hot key fills is then split
    by adaptive execution into as many tasks as its measured size asks for, while other keys' lookup rows aren't copied.
    Null keys match nothing, as in SQL. The lookup side should hold few, narrow columns.
    """
    on = list(on)
    if not _is_read(lookup):
        lookup = written(lookup, "lookup")
    if fits_broadcast(lookup, size):
        return large.join(F.broadcast(lookup), on, how)
    return large.join(lookup.hint("merge"), on, how)
