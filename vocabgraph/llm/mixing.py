"""Sources mixed to target shares of tokens, by pivotal dependent rounding of fractional copy numbers."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_ROWS = 20_000  # pages rounded together in one group
FAN = 64  # residuals combined in one group of the reduction tree


def count_tokens(documents: DataFrame, keep: list[str], *, text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, out: str = "n_tokens") -> DataFrame:
    """Columns ``keep`` and ``out``, the number of tokens of the whole text; null and empty texts have none.

    ``tokenizer``: path of a file of base64 tokens and ranks, read by the driver and broadcast (a vocabulary's size is fixed).
    """
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(tokenizer).read_bytes().splitlines() if line)}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], out])

    rows = documents.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(scan, f"{fields}, {out} bigint")


def pivot(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """(p with all but at most one entry 0 or 1, index of the one left or -1), expectations and the sum of size x p kept.

    Two fractional entries at a time: mass moves between them, one way or the other, as far as the first turns whole;
    the way is drawn so that neither's expectation changes. Entries without size are drawn alone.
    """
    out = np.clip(np.array(p, float), 0.0, 1.0)
    eps = 1e-9
    draws = random.random(len(out))
    holder = -1
    for j in range(len(out)):
        pj = out[j]
        if pj <= eps or pj >= 1 - eps:
            out[j] = round(pj)
            continue
        b = float(size[j])
        if b <= 0:
            out[j] = float(draws[j] < pj)
            continue
        if holder < 0:
            holder = j
            continue
        a, pi = float(size[holder]), out[holder]
        up, down = min(a * (1 - pi), b * pj), min(a * pi, b * (1 - pj))
        if draws[j] * (up + down) < down:
            pi, pj = pi + up / a, pj - up / b
        else:
            pi, pj = pi - down / a, pj + down / b
        whole_i, whole_j = pi <= eps or pi >= 1 - eps, pj <= eps or pj >= 1 - eps
        out[holder] = round(pi) if whole_i else pi
        out[j] = round(pj) if whole_j else pj
        holder = -1 if whole_i and whole_j else j if whole_i else holder
    return out, holder


def plan_shares(sizes: DataFrame, targets: DataFrame, *, source: str = "source", share: str = "target_share", repeats: str = "max_repeats", total: int | None = None) -> list[dict]:
    """One entry per source of ``targets``: pages, tokens, goal in tokens and copies per page (may be fractional).

    Shares of sources without tokens can't be reached; the others' shares are set in proportion. Without ``total`` the
    largest total is taken at which every source keeps within its repeats; with it, a source that would need more
    stays at its cap.
    """
    rows = targets.select(F.col(source).alias("source"), F.col(share).cast("double").alias("share"), F.col(repeats).cast("int").alias("cap")).where("source IS NOT NULL AND share > 0 AND cap > 0")
    rows = rows.groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_tokens").alias("tokens"))
    plan = [r.asDict() for r in rows.join(have, "source", "left").collect()]  # one row per target
    live = [r for r in plan if r["tokens"]]
    whole = sum(r["share"] for r in live)
    goal = total if total is not None else min((r["cap"] * r["tokens"] / (r["share"] / whole) for r in live), default=0)
    for r in plan:
        r["pages"], r["tokens"] = r["pages"] or 0, r["tokens"] or 0
        r["goal"] = goal * r["share"] / whole if r["tokens"] else 0.0
        r["copies"] = min(float(r["cap"]), r["goal"] / r["tokens"]) if r["tokens"] else 0.0
    return sorted(plan, key=lambda r: r["source"])


_ROUNDED = "doc_id bigint, source string, n_tokens bigint, base int, p double, bucket bigint, open boolean"


def mix(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: int | None = None, tokenizer: str = TOKENIZER, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pages, shares). pages: (doc_id, source, n_tokens, copies), copies >= 1; shares: one row per target with what was reached.

    Every page of a source has the same expected copies: the whole part is certain, the fraction is rounded dependently so
    that the source's tokens hit its goal to within one page. Rounding runs in buckets by a hash of doc_id (a source
    with a third of all pages is many buckets); each leaves at most one fractional page, and these residuals meet in a tree
    of fan-in 64 until one per source is left, which is drawn. The same seed and rows give the same pages.
    Pages of null or unlisted sources, null ids and sources with a null or zero share or cap aren't used; a page without
    tokens is drawn alone. Repeated rows of a page count as pages of their own.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND source IS NOT NULL")
    listed = targets.select(F.col(source).alias("source")).distinct()
    sizes = scratch.cut(count_tokens(rows.join(listed, "source", "left_semi"), ["doc_id", "source"], tokenizer=tokenizer), "sizes")
    plan = plan_shares(sizes, targets, source=source, total=total)
    schema = "source string, share double, cap int, pages bigint, tokens bigint, goal double, copies double, buckets bigint"
    for r in plan:
        r["buckets"] = max(1, -(-r["pages"] // bucket_rows))
    goals = spark.createDataFrame([tuple(r[k] for k in ("source", "share", "cap", "pages", "tokens", "goal", "copies", "buckets")) for r in plan], schema)

    def round_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "n_tokens"], kind="stable")
        text_key = "/".join(map(str, (seed, *key)))
        draw = np.random.default_rng(np.frombuffer(text_key.encode().ljust(-(-len(text_key.encode()) // 4) * 4, b"\0"), np.uint32))
        p, left = pivot(group["p"].to_numpy(), group["n_tokens"].to_numpy(), draw)
        open_ = np.zeros(len(group), bool)
        if left >= 0:
            open_[left] = True
        return group.assign(p=p, open=open_)[["doc_id", "source", "n_tokens", "base", "p", "bucket", "open"]]

    from_plan = goals.select("source", "copies", "buckets")
    state = sizes.join(F.broadcast(from_plan), "source").where("copies > 0")  # one row per target
    state = state.select("doc_id", "source", "n_tokens", F.floor("copies").cast("int").alias("base"), (F.col("copies") - F.floor("copies")).alias("p"), F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("bucket"))
    done = None
    most = max([r["buckets"] for r in plan], default=1)
    level = 0
    while True:
        rounded = state.withColumn("level", F.lit(level)).groupBy("source", "level", "bucket").applyInPandas(round_group, _ROUNDED)
        rounded = scratch.cut(rounded, f"rounded-{level}")
        closed = rounded.where("NOT open").select("doc_id", "source", "n_tokens", "base", F.col("p").alias("extra"))
        done = closed if done is None else done.unionByName(closed)
        rest = rounded.where("open").drop("open")
        if most == 1:
            break
        state = rest.withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("bigint"))
        most = -(-most // FAN)
        level += 1
    # one page per source is left: drawn by a hash of its id
    luck = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    done = done.unionByName(rest.select("doc_id", "source", "n_tokens", "base", F.when(luck < F.col("p"), 1.0).otherwise(0.0).alias("extra")))
    pages = done.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("extra").cast("int")).alias("copies")).where("copies > 0")
    used = pages.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_copies"), F.max("copies").alias("most_copies"))
    all_used = used.agg(F.sum("used_tokens").alias("_all"))
    shares = goals.join(used, "source", "left").join(F.broadcast(all_used)).select(  # one row
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("pages").alias("n_pages"), F.col("tokens").alias("n_tokens"), F.coalesce("used_copies", F.lit(0).cast("long")).alias("used_copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("used_tokens", F.lit(0).cast("long")).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"),
    )
    return pages, shares
