"""Text statistics per page and the kind of page they show, by a Gaussian mixture fitted with expectation-maximization."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .worker import once

STATS = ["n_words", "mean_word_length", "symbol_share", "digit_share", "ending_share", "common_share", "clean_share", "figure_line_share", "alike_line_share", "words_per_line"]
KINDS = ["prose", "list", "table", "junk"]
ENDINGS = ".!?;:,"
STRIP = ".,;:!?\"'()[]{}«»“”„*·-—|"
MAX_LABELS = 5_000  # labelled pages used to begin and to name the components
MAX_COMMON = 100_000  # common words that may be broadcast
MAX_TOKENS = 200_000  # distinct tokens a worker keeps in mind
PAGES = 200  # pages worked out together

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _end(ch: str, upper: bool) -> int:
    """What a line begins or ends with: a figure, a capital, another letter, or the sign itself."""
    return ord("9") if ch.isdigit() else ord("A") if upper and ch.isupper() else ord("a") if ch.isalpha() else ord(ch)


_LEN, _LETTERS, _DIGITS, _WORD, _ALPHA, _ALPHA_LEN, _CLEAN, _ENDS, _FIGURE, _ANY_DIGIT, _COMMA, _HEAD, _TAIL, _COMMON = range(14)


class Tokens:
    """What there is to know of each distinct token, worked out once: one number per token, one row of ``known`` per number."""

    def __init__(self, common: list[frozenset[str]]):
        self.common = common
        self.numbers: dict[str, int] = {}
        self.known = np.zeros((1024, _COMMON + len(common)), np.int32)

    def number(self, tokens: list[str]) -> np.ndarray:
        """The numbers of ``tokens``; a table grown beyond ``MAX_TOKENS`` is begun anew."""
        if len(self.numbers) > MAX_TOKENS:
            self.numbers = {}
        numbers = self.numbers
        new = list(set(tokens).difference(numbers))
        if new:
            at = len(numbers)
            while at + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[at : at + len(new)] = [self._row(t) for t in new]
            numbers.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))

    def _row(self, t: str) -> tuple[int, ...]:
        w = t.strip(STRIP).lower()
        alpha = bool(w) and w.isalpha()
        return (
            len(t), len(_NOT_LETTERS.sub("", t)), sum(map(t.count, "0123456789")), bool(w), alpha, len(w) if alpha else 0, alpha and len(w) >= 2, t[-1] in ENDINGS, t[0].isdigit() or t[-1].isdigit(), any(map(str.isdigit, t)), t[-1] == ",",
            _end(t[0], True), _end(t[-1], False), *[bool(w) and w in own for own in self.common],
        )


def batch_stats(texts: list[str | None], table: Tokens) -> np.ndarray:
    """The values of STATS, a row per text. Null texts and those without words have all zero."""
    tokens: list[str] = []
    sizes: list[int] = []  # tokens of each line that has any
    line_counts = []
    for text in texts:
        before = len(sizes)
        for line in (text or "").split("\n"):
            own = line.split()
            if own:
                tokens += own
                sizes.append(len(own))
        line_counts.append(len(sizes) - before)
    out = np.zeros((len(texts), len(STATS)))
    if not tokens:
        return out
    ids = table.number(tokens)
    known = table.known[ids]
    length = np.array(sizes)
    first = np.cumsum(length) - length
    lines = np.add.reduceat(known[:, [_ANY_DIGIT, _COMMA, _FIGURE]], first, axis=0)
    page_lines = np.array(line_counts)
    live = np.flatnonzero(page_lines)
    page_first = (np.cumsum(page_lines) - page_lines)[live]
    n_lines = page_lines[live]
    sums = np.add.reduceat(known, first[page_first], axis=0)
    n_tokens = np.add.reduceat(length, page_first)
    head, tail = known[first, _HEAD].astype(np.int64), known[first + length - 1, _TAIL].astype(np.int64)
    ends = np.add.reduceat(known[first + length - 1, _ENDS], page_first)
    figure_lines = np.add.reduceat((lines[:, 2] >= 2).astype(np.int64), page_first)
    # the shape of a line: how it begins and ends, its figures, its separators, roughly its length
    shape = (((head << 21 | tail) << 3 | np.minimum(lines[:, 0], 6)) << 3 | np.minimum(length, 12) // 2) << 15 | np.minimum(lines[:, 1], 2**15 - 1)
    page = np.repeat(np.arange(len(live)), n_lines)
    order = np.lexsort((shape, page))
    new = np.ones(len(order), bool)
    new[1:] = (page[order][1:] != page[order][:-1]) | (shape[order][1:] != shape[order][:-1])
    starts = np.flatnonzero(new)
    counts, owner = np.diff(np.append(starts, len(order))), page[order][starts]
    rank = np.lexsort((-counts, owner))
    place = np.arange(len(rank)) - np.searchsorted(owner[rank], owner[rank], side="left")
    alike = np.bincount(owner[rank][place < 2], weights=counts[rank][place < 2], minlength=len(live))
    words = np.maximum(1, sums[:, _WORD])
    solid = sums[:, _LEN]
    best = sums[:, _COMMON:].max(axis=1) if table.common else np.zeros(len(live), np.int64)
    out[live] = np.stack(
        [
            sums[:, _WORD], sums[:, _ALPHA_LEN] / np.maximum(1, sums[:, _ALPHA]), 1 - (sums[:, _LETTERS] + sums[:, _DIGITS]) / solid, sums[:, _DIGITS] / solid, ends / n_lines, best / words, sums[:, _CLEAN] / n_tokens,
            figure_lines / n_lines, alike / n_lines, sums[:, _WORD] / n_lines,
        ],
        axis=1,
    )
    return out


def page_stats(text: str | None, common: list[frozenset[str]]) -> list[float]:
    """The values of STATS of one text."""
    return batch_stats([text], Tokens(common))[0].tolist()


def _features(stats: np.ndarray) -> np.ndarray:
    """Counts as logarithms, shares on the arcsine scale, so that clusters look more like bells."""
    out = np.array(stats, float)
    for k, name in enumerate(STATS):
        out[:, k] = np.arcsin(np.sqrt(np.clip(out[:, k], 0, 1))) if name.endswith("share") else np.log1p(out[:, k])
    return out


@dataclass
class Mixture:
    """Weights, means and covariances of the components over standardized features, and the kind of each component."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kinds: np.ndarray  # components x KINDS: share of each kind

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return (_features(stats) - self.center) / self.scale

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        return np.exp(joint - total), float(total.sum())

    def moments(self, x: np.ndarray) -> np.ndarray:
        """Sufficient statistics of the rows, flat: likelihood, then per component weight, sums, second moments."""
        r, likelihood = self.responsibilities(x)
        second = np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
        return np.concatenate([[likelihood], r.sum(axis=0), (r.T @ x).ravel(), second.ravel()])

    def updated(self, flat: np.ndarray, ridge: float) -> Mixture:
        k, d = self.means.shape
        weight, sums, second = flat[1 : k + 1], flat[k + 1 : k + 1 + k * d].reshape(k, d), flat[k + 1 + k * d :].reshape(k, d, d)
        # each component keeps a few pseudo-rows of its present shape, so that rare ones neither vanish nor collapse
        prior = 3.0
        mass = weight + prior
        means = (sums + prior * self.means) / mass[:, None]
        cov = (second + prior * (self.covariances + np.einsum("ki,kj->kij", self.means, self.means))) / mass[:, None, None] - np.einsum("ki,kj->kij", means, means)
        return Mixture(self.center, self.scale, mass / mass.sum(), means, cov + ridge * np.eye(d), self.kinds)

    def named(self, stats: np.ndarray, labels: list[str]) -> Mixture:
        """Components named by the labelled pages they explain; one that explains none takes the kind it began with."""
        r, _ = self.responsibilities(self.standard(stats))
        share = np.stack([r[np.array([x == kind for x in labels])].sum(axis=0) for kind in KINDS], axis=1) + 0.05 * self.kinds
        return Mixture(self.center, self.scale, self.weights, self.means, self.covariances, share / share.sum(axis=1, keepdims=True))

    def kind_shares(self, stats: np.ndarray) -> np.ndarray:
        r, _ = self.responsibilities(self.standard(stats))
        return r @ self.kinds


def begin(stats: np.ndarray, labels: list[str], center: np.ndarray, scale: np.ndarray, per_kind: dict[str, int]) -> Mixture:
    """Components at labelled pages that lie far apart within their kind."""
    x = (_features(stats) - center) / scale
    means, kinds, weights = [], [], []
    for n, kind in enumerate(KINDS):
        own = x[np.array([v == kind for v in labels], bool)]
        if not len(own):
            continue
        picked = [own[np.argmin(((own - np.median(own, axis=0)) ** 2).sum(axis=1))]]
        while len(picked) < min(per_kind[kind], len(own)):
            apart = np.min([((own - p) ** 2).sum(axis=1) for p in picked], axis=0)
            if apart.max() <= 0:
                break
            picked.append(own[apart.argmax()])
        nearest = np.argmin([((own - p) ** 2).sum(axis=1) for p in picked], axis=0)
        for k, p in enumerate(picked):
            means.append(own[nearest == k].mean(axis=0))
            kinds.append(np.eye(len(KINDS))[n])
            weights.append(max(1, int((nearest == k).sum())) / len(x))
    d = x.shape[1]
    return Mixture(center, scale, np.array(weights) / sum(weights), np.array(means), np.stack([0.3 * np.eye(d)] * len(means)), np.array(kinds))


PER_KIND = {"prose": 4, "list": 4, "table": 3, "junk": 5}


def statistics(documents: DataFrame, common_words: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", word: str = "word", max_common: int = MAX_COMMON) -> DataFrame:
    """(doc_id, STATS): one row per row of ``documents``, in one scan without a shuffle.

    n_words: tokens with a letter or figure; mean_word_length: of all-letter words; symbol_share and digit_share: of the signs that aren't
    space; ending_share: lines that end in punctuation; common_share: words among the common words of the language that
    fits best (lang columns of pages are often wrong); clean_share: tokens that are plain words of two letters or more;
    figure_line_share: lines with two or more figures; alike_line_share: lines of the two commonest shapes;
    words_per_line. Null and empty texts have all zero. The common words are counted first and refused beyond ``max_common``.
    """
    listed = common_words.select(F.coalesce(F.col(lang), F.lit("")).alias("l"), F.lower(word).alias("w")).where("w IS NOT NULL").distinct()
    n = listed.count()
    if n > max_common:
        raise ValueError(f"{n} common words; at most {max_common} are broadcast")
    by: dict[str, set[str]] = defaultdict(set)
    for r in listed.collect():
        by[r.l].add(r.w)
    shared = documents.sparkSession.sparkContext.broadcast([frozenset(v) for _, v in sorted(by.items())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(shared, Tokens)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = np.concatenate([np.zeros((0, len(STATS))), *[batch_stats(texts[k : k + PAGES], table) for k in range(0, len(texts), PAGES)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(values[:, k]) for k in range(len(STATS))]], ["doc_id", *STATS])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS], axis=1)


def fit_mixture(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", kind: str = "page_class", per_kind: dict[str, int] | None = None, max_labels: int = MAX_LABELS, rounds: int = 12, tolerance: float = 1e-3, ridge: float = 0.02) -> Mixture:
    """A Gaussian mixture over the standardized statistics of all rows, its components named by labelled pages.

    ``stats`` should be a written table: it is read once per round. Each round adds up sufficient statistics per batch and
    sums them in the cluster; a few thousand numbers reach the driver. It ends after ``rounds``, or when the
    likelihood gains less than ``tolerance`` of itself. At most ``max_labels`` labelled pages (by hash of the id) are used.
    Labels of unknown kinds and of pages that aren't in ``stats`` are left out; without any label there is no model (ValueError).
    """
    values = [F.asin(F.sqrt(F.least(F.greatest(F.col(s), F.lit(0.0)), F.lit(1.0)))) if s.endswith("share") else F.log1p(s) for s in STATS]
    spread = stats.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    center = np.array([v or 0.0 for v in spread[: len(STATS)]])
    scale = np.maximum([v or 0.0 for v in spread[len(STATS) :]], 1e-6)
    own = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(kind).alias("kind")).where(F.col("kind").isin(KINDS)).dropDuplicates(["doc_id"])
    known = stats.join(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "doc_id").select("kind", *STATS).collect()  # at most max_labels
    if not known:
        raise ValueError("no labelled page")
    sample, kinds = np.array([r[1:] for r in known], float), [r[0] for r in known]
    model = begin(sample, kinds, center, scale, per_kind or PER_KIND)
    before = None
    for _ in range(rounds):

        def moments(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = model.moments(model.standard(_matrix(batch)))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

        sums = stats.select(*STATS).mapInArrow(moments, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        flat = np.array([r.v for r in sorted(sums, key=lambda r: r.pos)])
        model = model.updated(flat, ridge)
        if before is not None and abs(flat[0] - before) <= tolerance * abs(before):
            break
        before = flat[0]
    return model.named(sample, kinds)


def with_kind(stats: DataFrame, model: Mixture) -> DataFrame:
    """``stats`` plus page_class, the kind with the greatest share of a page's components, and kind_share. Pages without words are junk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch)
            shares = model.kind_shares(values) if len(values) else np.zeros((0, len(KINDS)))
            shares[values[:, 0] == 0] = np.array(KINDS) == "junk"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([KINDS[k] for k in shares.argmax(axis=1)], pa.string()), pa.array(shares.max(axis=1) if len(shares) else [], pa.float64())], [*batch.schema.names, "page_class", "kind_share"])

    own = stats.select("doc_id", *STATS)
    return own.mapInArrow(scan, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS) + ", page_class string, kind_share double")


def page_kinds(documents: DataFrame, common_words: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, STATS, page_class, kind_share) of every page: statistics, mixture, kinds.

    An empty table gives no rows. Without a labelled page kinds have no names: page_class is null but for pages without words,
    which are junk.
    """
    scratch = Scratch(documents.sparkSession, "quality")
    stats = scratch.cut(statistics(documents, common_words), "statistics")
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_class").alias("kind")).where(F.col("kind").isin(KINDS))
    if stats.join(own, "doc_id", "left_semi").isEmpty():
        return stats.select("*", F.when(F.col("n_words") == 0, "junk").alias("page_class"), F.when(F.col("n_words") == 0, 1.0).alias("kind_share"))
    return with_kind(stats, fit_mixture(stats, labels))
