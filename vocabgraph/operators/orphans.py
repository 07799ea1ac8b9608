"""References to records that do not exist, found with compressed bitmaps per key range and period.

A key is encoded as an integer: integral keys stand for themselves, other keys get codes from a dictionary. The high bits of
a code name its key range, the low 6 bits its place there. A bitmap holds the keys that a field refers to in a month, or the parents
delivered on a day, and is stored as its 64-bit words that aren't zero, one row each: dense stretches cost a bit a key, sparse ones
a word, each word by itself. Words are built by partial aggregation (``bit_or``) in the JVM, so a hot key costs one bit. Within a key range
the words are put in the order of time; a running ``bit_or`` of the parents gives what was delivered so far, and ``references AND NOT parents``
what wasn't. A range has at most one word per field and period, whatever the rows. The bits that survive are decoded, and
only they are compared row by row to name the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

WORD_BITS = 6  # a key range is what one 64-bit word holds
NEVER = 2**62


@dataclass(frozen=True)
class Reference:
    """A field that refers to the parent's key. ``loaded_at`` is the time the referring row was delivered."""

    frame: DataFrame
    table: str
    field: str
    loaded_at: str = "loaded_at"


def parent_state(parent: DataFrame, key: str, loaded_at: str = "loaded_at", invalid: str = "invalid_reason") -> DataFrame:
    """One row per key: first delivery, and whether a row of the latest delivery is marked deleted ('D').

    Null keys are dropped; a null delivery time counts as the earliest of all.
    """
    rows = parent.select(F.col(key).alias("key"), F.col(loaded_at).alias("at"), F.coalesce(F.col(invalid) == "D", F.lit(False)).alias("gone")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.min("at").alias("first_at"), F.max(F.struct("at", "gone"))["gone"].alias("deleted"))


def dictionary(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, code): codes are dense within each partition of the distinct keys. Written, because codes must not change."""
    coded = keys.distinct().repartition("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("code"))
    return scratch.cut(coded, "dictionary")


def _words(coded: DataFrame, group: list[str], at: str, edge) -> DataFrame:
    """(group, key_range, bits, edge): the words of one bitmap per ``group``; ``edge`` aggregates the times of a word."""
    bit = F.expr(f"shiftleft(1L, cast(code & {(1 << WORD_BITS) - 1} AS int))")
    return coded.groupBy(*group, F.shiftright("code", WORD_BITS).alias("key_range")).agg(F.bit_or(bit).alias("bits"), edge(at).alias("edge"))


def _not_covered(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(origin, period, code) of reference bits whose parent isn't in a word completed before the reference word's first row."""
    both = refs.select("key_range", "origin", "period", "bits", "edge", F.lit(1).alias("turn"))
    both = both.unionByName(parents.select("key_range", F.lit(None).cast("int").alias("origin"), F.lit(None).cast("string").alias("period"), "bits", "edge", F.lit(0).alias("turn")))
    so_far = Window.partitionBy("key_range").orderBy("edge", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.coalesce(F.bit_or(F.when(F.col("turn") == 0, F.col("bits"))).over(so_far), F.lit(0).cast("long"))
    left = both.withColumn("left", F.col("bits").bitwiseAND(F.bitwise_not(there))).where("turn = 1 AND left <> 0")
    places = F.expr(f"filter(sequence(0, {(1 << WORD_BITS) - 1}), i -> (shiftrightunsigned(left, i) & 1) = 1)")
    return left.select("origin", "period", "key_range", F.explode(places).alias("place")).select("origin", "period", (F.shiftleft("key_range", WORD_BITS) + F.col("place")).alias("code"))


def orphan_references(references: list[Reference], parent: DataFrame, key: str, *, loaded_at: str = "loaded_at", invalid: str = "invalid_reason", encode: str = "identity") -> DataFrame:
    """(origin_table, ref_field, key, load_month, reason), one row each, for references without a valid parent.

    reason: 'missing' (no such key), 'deleted' (its latest row is marked 'D'), 'late' (first delivered after the referring
    row). Null references are no cases; a referring row without a delivery time can be missing or deleted (load_month
    null), never late. ``encode``: 'identity' for integral keys, 'dictionary' for any other. Empty tables give no rows.
    """
    if encode not in ("identity", "dictionary"):
        raise ValueError("encode is 'identity' or 'dictionary'")
    spark = parent.sparkSession
    scratch = Scratch(spark, "orphans")
    state = parent_state(parent, key, loaded_at, invalid)
    refs = None
    for n, r in enumerate(references):
        part = r.frame.select(F.lit(n).alias("origin"), F.col(r.field).alias("key"), F.col(r.loaded_at).alias("at")).where("key IS NOT NULL")
        refs = part if refs is None else refs.unionByName(part)
    if refs is None:
        raise ValueError("no references given")
    if encode == "dictionary":
        codes = dictionary(refs.select("key").unionByName(state.select("key")), scratch)
        coded, coded_state = refs.join(codes, "key"), state.join(codes, "key")
    else:
        coded = refs.withColumn("code", F.col("key").cast("long"))
        coded_state = state.withColumn("code", F.col("key").cast("long"))
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    month = lambda c: F.coalesce(F.date_format(c, "yyyy-MM"), F.lit(""))
    asked = _words(coded.select("origin", "code", month("at").alias("period"), F.coalesce(number("at"), F.lit(NEVER)).alias("micros")), ["origin", "period"], "micros", F.min)
    alive = coded_state.where("NOT deleted").select("code", F.to_date("first_at").alias("day"), F.coalesce(number("first_at"), F.lit(-NEVER)).alias("micros"))
    left = _not_covered(asked, _words(alive, ["day"], "micros", F.max))
    left = left.join(codes, "code") if encode == "dictionary" else left.withColumn("key", F.col("code").cast(parent.schema[key].dataType))
    # every survivor is a case, or may be one within its month: the row's own time decides
    survivors = left.join(state, "key", "left").withColumn("reason", F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").otherwise("late"))
    survivors = scratch.cut(survivors.select("origin", "key", "period", "first_at", "reason"), "survivors")
    sure = survivors.where("reason <> 'late'").select("origin", "key", "period", "reason")
    dubious = survivors.where("reason = 'late'")
    late = refs.withColumn("period", month("at")).join(dubious, ["origin", "key", "period"]).where("at < first_at").select("origin", "key", "period", "reason").distinct()
    table, field = (F.array(*[F.lit(getattr(r, x)) for r in references])[F.col("origin")] for x in ("table", "field"))
    return sure.unionByName(late).select(table.alias("origin_table"), field.alias("ref_field"), "key", F.when(F.col("period") != "", F.col("period")).alias("load_month"), "reason").distinct()


def orphan_report(cases: DataFrame) -> DataFrame:
    """Counts of orphan keys per table, field, month and reason, with the share of each reason in its month."""
    counts = cases.groupBy("origin_table", "ref_field", "load_month", "reason").agg(F.count(F.lit(1)).alias("n_keys"))
    month = Window.partitionBy("origin_table", "ref_field", "load_month")
    return counts.withColumn("share", F.round(F.col("n_keys") / F.sum("n_keys").over(month), 6))
