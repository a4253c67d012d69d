"""References to records that don't exist or came later: bitmaps per key range and period, reference AND NOT parent."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from touchline.operators.lookup import lookup_join
from touchline.session import written

#: Keys of one range, the bits of a long.
WORD_BITS = 6
#: Length of a bitmap's period. Short periods leave few candidates for the exact check.
PERIOD_SECONDS = 5


@dataclass(frozen=True)
class Reference:
    """One referring table with its (field, target) references, read in one scan."""

    table: str
    rows: DataFrame
    fields: Sequence[tuple[str, str]]


def dictionary(*keys: DataFrame, buckets: int = 4096) -> DataFrame:
    """Codes for keys that aren't integers: key string, code long. Codes are dense within a bucket of the key's hash."""
    every = reduce(DataFrame.unionByName, [k.select(F.col(k.columns[0]).cast("string").alias("key")) for k in keys]).dropna().distinct()
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("key"))
    return every.withColumn("_bucket", bucket).select("key", (F.shiftleft(F.col("_bucket"), 40) + rank).alias("code"))


def _period(at: Column) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(PERIOD_SECONDS * 1_000_000)).cast("long")


def _word(key: Column) -> Column:
    return F.shiftright(key, WORD_BITS)


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), key.bitwiseAND(F.lit(63)).cast("int"))


def orphan_references(references: Sequence[Reference], parents: dict[str, DataFrame], row_id: str = "id", created: str = "created_at", parent_key: str = "id") -> DataFrame:
    """References whose target is missing or was created later.

    Columns: ref_table, ref_field, ref_id, kind ("missing" or "late"), created_at of the referring row. One row per
    reference; exact copies count once. A parent's creation is the earliest of its versions.

    Integer keys are their own codes; if any key is of another type, all are encoded by `dictionary`. A table and field
    is a small number. References are first reduced to the earliest row of each field, key and period, then gathered
    into bitmaps per field, key range and period, of which only words that aren't empty are held; parents into bitmaps
    per key range and period of creation. AND NOT with all parents leaves missing keys; AND NOT with the parents of
    earlier periods leaves keys that may be late, which is decided for a key and period by its earliest row. Only
    surviving bits, of which each stands for at least one orphan, are decoded, written and met with their rows.

    Nulls: a null reference is none; a null creation time of the row or of all versions of its parent is never late.
    Empty tables give no rows, except that all references to an empty parent table are missing.
    """
    types = [r.rows.schema[f].dataType for r in references for f, _ in r.fields] + [p.schema[parent_key].dataType for p in parents.values()]
    kind = "long" if all(isinstance(t, IntegralType) for t in types) else "string"
    names, target_no = [], {name: i for i, name in enumerate(parents)}
    small = lambda i: F.lit(i).cast("smallint")
    refs = None
    for r in references:
        pairs = []
        for f, t in r.fields:
            pairs.append(F.struct(small(len(names)).alias("field"), small(target_no[t]).alias("target"), F.col(f).cast(kind).alias("key")))
            names.append((r.table, f))
        one = r.rows.select(F.col(row_id).cast("long").alias("ref_id"), F.col(created).alias("created_at"), F.inline(F.array(*pairs)))
        refs = one if refs is None else refs.unionByName(one)
    refs = refs.where(F.col("key").isNotNull()).withColumn("period", F.coalesce(_period(F.col("created_at")), F.lit(-1)))

    known = None
    for name, df in parents.items():
        one = df.select(small(target_no[name]).alias("target"), F.col(parent_key).cast(kind).alias("key"), F.col(created).alias("born"))
        known = one if known is None else known.unionByName(one)
    known = known.where("key is not null").groupBy("target", "key").agg(F.min("born").alias("born"))
    if kind == "string":
        codes = written(dictionary(refs.select("key"), known.select("key")), "dictionary")
        refs = lookup_join(refs, codes, ["key"]).drop("key").withColumnRenamed("code", "key")
        known = lookup_join(known, codes, ["key"]).drop("key").withColumnRenamed("code", "key")
    known = written(known, "parents")  # read for the bitmaps and for the times of survivors
    earliest = written(refs.groupBy("field", "target", "key", "period").agg(F.min("created_at").alias("first_at")), "references")

    parent_bits = (
        known.groupBy("target", _word(F.col("key")).alias("word"), F.coalesce(_period(F.col("born")), F.lit(-1)).alias("period"))
        .agg(F.bit_or(_bit(F.col("key"))).alias("bits"))
        .groupBy("target", "word")
        .agg(F.collect_list(F.struct("period", "bits")).alias("parents"), F.bit_or("bits").alias("every"))
    )
    ref_bits = earliest.groupBy("field", "target", _word(F.col("key")).alias("word"), "period").agg(F.bit_or(_bit(F.col("key"))).alias("bits"))
    met = ref_bits.join(parent_bits.hint("merge"), ["target", "word"], "left")
    before = F.aggregate(
        F.filter(F.coalesce("parents", F.expr("cast(array() as array<struct<period:bigint,bits:bigint>>)")), lambda p: p["period"] < F.col("period")),
        F.lit(0).cast("long"),
        lambda a, p: a.bitwiseOR(p["bits"]),
    )
    every = F.coalesce("every", F.lit(0).cast("long"))
    gone = F.struct(F.lit(True).alias("absent"), F.col("bits").bitwiseAND(F.bitwise_not(every)).alias("left"))
    may_be_late = F.struct(F.lit(False).alias("absent"), F.col("bits").bitwiseAND(every).bitwiseAND(F.bitwise_not(before)).alias("left"))
    survivors = met.select("field", "target", "word", "period", F.inline(F.array(gone, may_be_late))).where("left <> 0")
    decoded = survivors.withColumn("b", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftright(left, b) & 1L) = 1L)"))).select(
        "field", "target", "period", "absent", (F.shiftleft("word", WORD_BITS) + F.col("b")).alias("key")
    )
    missing = decoded.where("absent").select("field", "key", "period", "absent", F.lit(None).cast("timestamp").alias("born"))
    late = (
        decoded.where("not absent")
        .join(known.hint("merge"), ["target", "key"])
        .join(earliest.hint("merge"), ["field", "target", "key", "period"])
        .where("born > first_at")
        .select("field", "key", "period", "absent", "born")
    )
    orphans = written(missing.unionByName(late), "orphans")
    rows = lookup_join(refs.drop("target"), orphans, ["field", "key", "period"]).where(F.col("absent") | (F.col("born") > F.col("created_at")))
    name = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f in names])[F.col("field")]
    return (
        rows.select("field", "ref_id", "absent", "created_at")
        .distinct()
        .select(name["t"].alias("ref_table"), name["f"].alias("ref_field"), "ref_id", F.when(F.col("absent"), "missing").otherwise("late").alias("kind"), "created_at")
    )


def orphan_report(orphans: DataFrame, every: str = "day") -> DataFrame:
    """Orphans per table, field, kind and period (a unit of date_trunc); rows without a creation time have a null period."""
    return orphans.groupBy("ref_table", "ref_field", "kind", F.date_trunc(every, "created_at").alias("period")).agg(F.count(F.lit(1)).alias("n_orphans"))
