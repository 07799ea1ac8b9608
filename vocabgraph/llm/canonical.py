"""Free-entered names mapped to the closest entry of a reference list, by a BK-tree over the entries."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .bktree import BKTree, distance
from .lookalike import comparable
from .worker import once

# Remarks typed around a name; they are no part of it.
REMARKS_BEFORE = ["old code:", "query", "pt:", "hx of", "new -", "re", "*", "?"]
REMARKS_AFTER = ["see chart", "[free text]", "(site entry)", "nos", "- confirmed", "...", "/", "*", "?"]
# Short ways to type a word.
SHORT_WORDS = {
    "ac": "acute", "acut": "acute", "asst": "assistant", "cap": "capsule", "caps": "capsule", "chr": "chronic", "chron": "chronic", "clin": "clinic", "infirm": "infirmary", "inh": "inhaler", "jnr": "junior", "jr": "junior",
    "mgs": "mg", "milligram": "mg", "milligrams": "mg", "n": "north", "nth": "north", "o": "of", "oint": "ointment", "paed": "paediatric", "pediatric": "paediatric", "rec": "recurrent", "recur": "recurrent", "reg": "registrar",
    "s": "south", "snr": "senior", "sr": "senior", "sth": "south", "tab": "tablet", "tabl": "tablet", "tbl": "tablet", "tech": "technician", "techn": "technician", "th": "the", "ty": "type", "typ": "type", "upr": "upper", "vis": "visiting",
}

_TOKENS = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
SHARD_ENTRIES = 20_000  # entries in one tree; a longer list is sharded
TASK_TEXTS = 20_000  # texts searched by one task


@dataclass(frozen=True)
class Settings:
    """``share``: edits allowed as a share of the rarest word's length; ``most``: edits allowed at all; ``common``: a word found in
    so many entries is a qualifier, told apart exactly; the remaining fields are the word lists."""

    share: float = 0.34
    most: int = 4
    common: int = 3
    before: tuple[str, ...] = tuple(REMARKS_BEFORE)
    after: tuple[str, ...] = tuple(REMARKS_AFTER)
    short_words: dict[str, str] = field(default_factory=lambda: dict(SHORT_WORDS))


def words(text: str) -> list[str]:
    return _TOKENS.findall(text)


def strip(text: str, settings: Settings) -> str:
    """A comparable text without the remarks around it, again and again."""
    text = text.replace("_", " ").strip()
    while True:
        start = text
        for remark in settings.before:
            tail = text[len(remark) :]
            if text.startswith(remark) and (not remark[-1].isalnum() or not tail or not tail[0].isalnum()):
                text = tail.lstrip(" ,;:-./")
        for remark in settings.after:
            if text.endswith(remark) and (not remark[0].isalnum() or len(text) == len(remark) or not text[-len(remark) - 1].isalnum()):
                text = text[: -len(remark)].rstrip(" ,;:-")
        if text == start:
            return text


def figures(text: str) -> tuple[str, ...]:
    return tuple(sorted(_DIGITS.findall(text)))


class Matcher:
    """One tree over all word rotations of the entries' names, and the entries' short forms, which match exactly only.

    ``spread`` (entries a word is found in) and ``swaps`` are taken from ``entries``, unless those are only a part of the list. A key's
    radius in the tree is the greatest number of edits its words allow; texts and keys meet only if their figures are the same.
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], settings: Settings, spread: Counter | None = None, swaps: dict[str, set[str]] | None = None):
        self.settings = settings
        named = [(i, words(comparable(n))) for i, n, _ in entries if n and words(comparable(n))]
        self.spread = Counter(w for _, ws in named for w in set(ws)) if spread is None else spread
        self.swaps = qualifier_swaps([ws for _, ws in named]) if swaps is None else swaps
        self.owners: dict[str, dict[tuple[str, ...], set[int]]] = defaultdict(lambda: defaultdict(set))  # per key, by its words
        for i, ws in named:
            for k in range(len(ws)):
                turned = ws[k:] + ws[:k]
                self.owners["".join(turned)][tuple(turned)].add(i)
        self.codes: dict[str, set[int]] = defaultdict(set)
        for i, _, code in entries:
            if code and words(comparable(code)):
                self.codes["".join(words(comparable(code)))].add(i)
        radius = dict.fromkeys(self.codes, 0) | {k: max(map(self.allowed, parts)) for k, parts in self.owners.items()}
        self.tree = BKTree(list(radius), radius, {k: figures(k) for k in radius})
        self.longest = max(map(len, self.tree.keys), default=0) + settings.most

    def forms(self, text: str, deep: bool) -> list[str]:
        """The ways to read a stripped text: short words written out; if ``deep``, also those glued to the next or last word."""
        ws = words(text)
        short = self.settings.short_words
        full = [short.get(w, w) for w in ws]
        if min(sum(map(len, ws)), sum(map(len, full))) > self.longest:  # too far from every key
            return []
        out = ["".join(full)]
        if deep:
            out = []
            for i, w in enumerate(ws):
                for cut, whole in short.items():
                    if len(cut) > 1 and len(w) > len(cut) + 4:
                        if w.startswith(cut) and not w.startswith(whole):
                            out.append("".join([*full[:i], whole, w[len(cut) :], *full[i + 1 :]]))
                        if w.endswith(cut) and not w.endswith(whole):
                            out.append("".join([*full[:i], w[: -len(cut)], whole, *full[i + 1 :]]))
        else:
            plain = "".join(ws)  # a short word may be the beginning of a longer one
            if plain != out[0]:
                out.append(plain)
        return list(dict.fromkeys(x for x in out if x))

    def allowed(self, parts: tuple[str, ...]) -> int:
        rare = [w for w in parts if self.spread[w] <= self.settings.common and not w.isdigit()]
        longest = max(map(len, rare or parts))
        return min(self.settings.most, max(1, int(self.settings.share * longest)))

    def contradicted(self, form: str, parts: tuple[str, ...], d: int) -> bool:
        """Whether another qualifier in the same place would fit no worse."""
        if d == 0:
            return False
        for i, w in enumerate(parts):
            for other in self.swaps.get(w, ()):
                if not w.isdigit() and distance("".join([*parts[:i], other, *parts[i + 1 :]]), form) <= d:
                    return True
        return False

    def match(self, texts: list[str], only: int | None = None) -> list[list[tuple[int, int]]]:
        """Per stripped text: every uncontradicted (entry, distance) within the threshold.

        Texts without one are read again with short words taken apart (``only``: 0 leaves that out, 1 does nothing else).
        """
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        todo = list(range(len(texts)))
        for deep in (False, True) if only is None else (bool(only),):
            forms = [(i, f) for i in todo for f in self.forms(texts[i], deep)]
            at, key, dist = self.tree.search([f for _, f in forms], np.full(len(forms), self.settings.most), [figures(f) for _, f in forms])
            for a, k, d in zip(at.tolist(), key.tolist(), dist.tolist()):
                i, form = forms[a]
                name = self.tree.keys[k]
                owners = set(self.codes.get(name, ())) if d == 0 else set()
                for parts, own in self.owners.get(name, {}).items():
                    if d <= self.allowed(parts) and not self.contradicted(form, parts, d):
                        owners |= own
                out[i].extend((o, d) for o in owners)
            todo = [i for i in todo if not out[i]]
        return out


def qualifier_swaps(entries: list[list[str]]) -> dict[str, set[str]]:
    """Words that stand for each other in otherwise equal entries: such entries mean different things."""
    frames: dict[tuple, set[str]] = defaultdict(set)
    for ws in entries:
        for i, w in enumerate(ws):
            frames[(*ws[:i], None, *ws[i + 1 :])].add(w)
    out: dict[str, set[str]] = defaultdict(set)
    for group in frames.values():
        for w in group:
            out[w] |= group - {w}
    return dict(out)


def best(matches: list[tuple[int, int]]) -> tuple[int | None, int | None, int]:
    """(entry, distance, how many entries share the least distance); no entry if that is not exactly one."""
    if not matches:
        return None, None, 0
    least = min(d for _, d in matches)
    ids = sorted({i for i, d in matches if d == least})
    return (ids[0] if len(ids) == 1 else None), least, len(ids)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries with the words of their names."""
    for batch in batches:
        yield batch.assign(ws=[words(comparable(n)) if isinstance(n, str) and n else [] for n in batch["name"]])


def _word_statistics(listed: DataFrame) -> DataFrame:
    """(word, n, others): how many entries hold a word, and its ``qualifier_swaps`` (null if none), over the whole list."""
    spread = listed.select(F.explode(F.array_distinct("ws")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    places = listed.select("ws").distinct().select("ws", F.posexplode("ws").alias("pos", "word"))
    frames = places.groupBy(F.expr("slice(ws, 1, pos)").alias("before"), F.expr("slice(ws, pos + 2, size(ws))").alias("after")).agg(F.collect_set("word").alias("group")).where("size(group) > 1")
    pairs = frames.select("group", F.explode("group").alias("word")).select("word", F.explode("group").alias("other")).where("word <> other")
    return spread.join(pairs.groupBy("word").agg(F.collect_set("other").alias("others")), "word", "left")


_FOUND = "stripped string, entry_id bigint, distance int, n_closest int"


def _frame(texts: list[str], matches: list[list[tuple[int, int]]]) -> pd.DataFrame:
    won = [best(m) for m in matches]
    return pd.DataFrame(
        {"stripped": pd.Series(texts, dtype=object), "entry_id": pd.array([w[0] for w in won], "Int64"), "distance": pd.array([w[1] for w in won], "Int32"), "n_closest": pd.array([w[2] for w in won], "Int32")}
    )


def map_names(names: DataFrame, column: str, entries: DataFrame, *, entry_id: str = "canonical_id", entry_name: str = "canonical_name", short_form: str | None = "short_form", settings: Settings | None = None, shard_entries: int = SHARD_ENTRIES, partitions: int | None = None) -> DataFrame:
    """(text, entry_id, distance, n_closest): one row per distinct text of ``column``, entry_id null where none is meant.

    The texts are made comparable and remarks around them removed; what is the same then is searched once. Short words are written out; the
    tree holds every rotation of an entry's words, so words moved from one end to the other don't count as edits. Of all the entries within the
    threshold the closest wins; if several are equally close, entry_id is null and n_closest tells how many; n_closest 0 means
    no entry is near. Null texts give no row, empty ones an unmatched row. Entries with null or empty names match by
    short form only. An entry list of up to ``shard_entries`` (counted) is broadcast as one tree, built once per Python worker. A longer one is
    split by a hash of the id; every shard sees every text and what the whole list says of its own words, sends on its closest
    entries, and these merge before the rest is read with short words taken apart. So the shards give the rows of one tree.
    """
    settings = settings or Settings()
    spark = names.sparkSession
    scratch = Scratch(spark, "names")

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stripped=[strip(comparable(t), settings) for t in batch["text"]])

    texts = names.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct().mapInPandas(prepare, "text string, stripped string")
    texts = scratch.cut(texts, "texts")
    asked = texts.select("stripped").distinct()
    asked, n_texts = scratch.counted(asked, "asked")
    code = F.col(short_form) if short_form else F.lit(None).cast("string")
    rows = entries.select(F.col(entry_id).cast("bigint").alias("id"), F.col(entry_name).alias("name"), code.alias("code")).where("id IS NOT NULL").distinct()
    rows, n = scratch.counted(rows, "entries")
    width = partitions or max(spark.sparkContext.defaultParallelism, -(-n_texts // TASK_TEXTS))
    if n <= shard_entries:
        listed = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # counted above

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = once(listed, lambda own: Matcher(own, settings))
            for batch in batches:
                own = batch["stripped"].tolist()
                yield _frame(own, tree.match(own))

        return texts.join(asked.repartition(width).mapInPandas(search, _FOUND), "stripped").drop("stripped")
    shards = -(-n // shard_entries)
    blocks = max(1, width // shards)
    listed = scratch.cut(rows.mapInPandas(_split, "id bigint, name string, code string, ws array<string>").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")), "shards")
    own_words = listed.select("shard", F.explode("ws").alias("word")).distinct()
    about = own_words.join(_word_statistics(listed), "word").select("shard", "word", "n", "others")
    shared = listed.select("shard", F.col("id").cast("string").alias("id"), "name", "code").unionByName(about, allowMissingColumns=True)
    copies = scratch.cut(shared, "copies").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search_shard(reach: int):
        def shard(texts_: pd.DataFrame, entries_: pd.DataFrame) -> pd.DataFrame:
            own = texts_["stripped"].tolist()
            about, listed = entries_[entries_["word"].notna()], entries_[entries_["id"].notna()]
            listed = [(int(i), *(None if pd.isna(x) else x for x in nc)) for i, *nc in zip(listed["id"], listed["name"], listed["code"])]
            spread = Counter(dict(zip(about["word"], about["n"].astype(int))))
            swaps = {w: set(x) for w, x in zip(about["word"], about["others"]) if x is not None}
            matches = Matcher(listed, settings, spread, swaps).match(own, reach) if own else []
            flat = [(t, i, d) for t, m in zip(own, matches) for i, d in set(m) if d == min(x for _, x in m)]
            return pd.DataFrame({"stripped": pd.Series([f[0] for f in flat], dtype=object), "entry_id": pd.array([f[1] for f in flat], "Int64"), "distance": pd.array([f[2] for f in flat], "Int32")})

        return shard

    left, parts = asked, None
    for reach in range(2):
        sent = left.select("stripped", F.pmod(F.xxhash64("stripped"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        met = sent.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(search_shard(reach), "stripped string, entry_id bigint, distance int")
        met = scratch.cut(met, "met")
        parts = met if parts is None else parts.unionByName(met)
        left = scratch.cut(left.join(met.select("stripped").distinct(), "stripped", "left_anti"), "left")
    closest = parts.groupBy("stripped").agg(F.min("distance").alias("distance"), F.collect_set(F.struct("distance", "entry_id")).alias("all"))
    won = F.filter("all", lambda x: x["distance"] == F.col("distance"))
    found = closest.select("stripped", F.when(F.size(won) == 1, F.element_at(won, 1)["entry_id"]).alias("entry_id"), "distance", F.size(won).alias("n_closest"))
    found = found.unionByName(left.select("stripped", F.lit(None).cast("bigint").alias("entry_id"), F.lit(None).cast("int").alias("distance"), F.lit(0).alias("n_closest")))
    return texts.join(found, "stripped").drop("stripped")
