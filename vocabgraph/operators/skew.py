"""Per-key results when a few keys hold most rows: eager aggregation through joins, and salted distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def key_profile(rows: DataFrame, key: str, distinct: dict[str, str], *, salts: int = 32) -> DataFrame:
    """(key, n_rows, one distinct count per entry of ``distinct``: output name -> column) without a hot task.

    Rows are pre-aggregated map-side, in one scan, to their compact states: one row per (key, value) for each counted column. Those
    states are spread by a hash of the value, counted per (key, salt), and only the salted counts meet per key: a key holding
    a third of all rows reaches the last task as at most ``salts`` rows per column. Null values are not counted as
    partners; rows with a null key form no group. Repeated rows count in n_rows. An empty table gives no rows.
    """
    base = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(distinct.values())]).where("_k IS NOT NULL")
    if not distinct:
        return base.groupBy(F.col("_k").alias(key)).agg(F.count(F.lit(1)).alias("n_rows"))
    values = [f"_c{i}" for i in range(len(distinct))]
    each = base.withColumn("_w", F.explode(F.array(*map(F.lit, range(len(distinct))))))  # one scan, one shuffle for all counted columns
    own = [F.when(F.col("_w") == i, F.col(v)).alias(v) for i, v in enumerate(values)]
    state = each.select("_k", "_w", *own).groupBy("_k", "_w", *values).agg(F.count(F.lit(1)).alias("_n"))
    known = F.coalesce(*[F.when(F.col(v).isNotNull(), 1) for v in values], F.lit(0))
    salted = state.groupBy("_k", "_w", F.pmod(F.xxhash64(*values), F.lit(salts)).alias("_s")).agg(F.sum(known).alias("_d"), F.sum("_n").alias("_n"))
    out = salted.groupBy("_k").agg(
        F.sum(F.when(F.col("_w") == 0, F.col("_n"))).alias("n_rows"),
        *[F.sum(F.when(F.col("_w") == i, F.col("_d")).otherwise(0)).alias(name) for i, name in enumerate(distinct)],
    )
    return out.withColumnRenamed("_k", key)


def row_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows), counted map-side first; null keys form no group."""
    return rows.select(F.col(key).alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def joined_states(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(key, n_left, n_right, n_pairs): per key the rows on each side and the rows that joining the two on it would give.

    Both sides are aggregated by the key first, map-side; only the compact states are joined (full outer), and the counts multiplied. Null keys
    are counted in a row of their own, with no pairs. A key holding a third of all rows is one row of each side.
    """
    sides = [rows.select(F.col(key).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias(name)) for rows, key, name in ((left, left_key, "n_left"), (right, right_key, "n_right"))]
    a, b = sides[0].alias("a"), sides[1].alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), "full")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = both.select(F.coalesce("a.key", "b.key").alias("key"), count("n_left").alias("n_left"), count("n_right").alias("n_right"))
    return out.withColumn("n_pairs", F.when(F.col("key").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_left") * F.col("n_right")))


def heavy_join_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, share: float) -> DataFrame:
    """(key, side, n_rows, share, n_pairs): keys that hold at least ``share`` of all rows of a side ('left' or 'right'), with the pairs they would join to.

    By eager aggregation: the joined states of both sides are written once, the totals roll up with the write, and at most 2 / share
    keys come out. Repeated rows and null keys count in the totals; a null key is never named. An empty side gives no rows.
    """
    scratch = Scratch(left.sparkSession, "heavy")
    states, total = scratch.measured(joined_states(left, right, left_key, right_key), "states", left=F.sum("n_left"), right=F.sum("n_right"))
    parts = []
    for side in ("left", "right"):
        n, whole = F.col(f"n_{side}"), F.lit(float(total[side] or 0))
        parts.append(states.where(F.col("key").isNotNull() & (n > 0) & (n >= whole * share)).select("key", F.lit(side).alias("side"), n.alias("n_rows"), (n / whole).alias("share"), "n_pairs"))
    return parts[0].unionByName(parts[1])


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_key: str, right_key: str, group: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Aggregate of ``left JOIN right ON left_key = right_key GROUP BY group`` (a column of ``left``) without building the join.

    Both sides are pre-aggregated by the join key: ``left`` to (group, key, count), ``right`` to (key, count, sums). The
    compact states are joined; counts multiply, and a sum over ``right`` is multiplied by the count of ``left``. Then the
    result rolls up to ``group``. Join sizes grow as the square of a hot key's rows, the states do not.
    Null keys never match; a null group is a group of its own. Columns: group, n_pairs, and the names of ``sums``.
    """
    sums = sums or {}
    states = right.select(F.col(right_key).alias("_k"), *[v.alias(k) for k, v in sums.items()]).where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_r"), *[F.sum(k).alias(k) for k in sums])
    compact = left.select(F.col(group).alias("_g"), F.col(left_key).alias("_k")).where("_k IS NOT NULL").groupBy("_g", "_k").agg(F.count(F.lit(1)).alias("_l"))
    joined = compact.join(states, "_k")
    out = joined.groupBy("_g").agg(F.sum(F.col("_l") * F.col("_r")).alias("n_pairs"), *[F.sum(F.col("_l") * F.col(k)).alias(k) for k in sums])
    return out.withColumnRenamed("_g", group)
