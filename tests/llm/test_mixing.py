import base64

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from vocabgraph.llm.mixing import PATTERN, TOKENIZER, count_tokens, mix, pivot


def test_pivot_keeps_mass_and_expectations():
    rng = np.random.default_rng(1)
    p, size = rng.random(200), rng.integers(1, 900, 200)
    out, left = pivot(p, size, rng)
    whole = np.delete(out, left) if left >= 0 else out
    assert set(whole) <= {0.0, 1.0} and abs((out * size).sum() - (p * size).sum()) < 1e-6
    small, weights = np.array([0.3, 0.5, 0.9, 0.0, 1.0, 0.2]), np.array([5, 1, 3, 2, 2, 0])
    mean = np.mean([pivot(small, weights, np.random.default_rng(s))[0] for s in range(6000)], axis=0)
    assert np.abs(mean - small).max() < 0.03
    assert pivot(np.zeros(0), np.zeros(0), rng)[1] == -1


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, "big" if i % 3 else "small", "word " * (1 + i * 7 % 40), "x") for i in range(900)] + [(None, "big", "a", "x"), (901, None, "a", "x"), (902, "other", "a", "x"), (903, "small", None, "x"), (904, "small", "", "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, copies string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 3), ("none", 0.05, 2), ("zero", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_tokens(spark, pages):
    coder = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}, special_tokens={})
    texts = ["", None, "Mr. Loris doesn't <|endoftext|> käse\n\n  1881", "a" * 3000]
    rows = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "id long, text string, n_tokens string")
    assert {r.id: r.n_tokens for r in count_tokens(rows, ["id"]).collect()} == {i: len(coder.encode_ordinary(t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bucket_rows", [20_000, 4])
def test_mix(pages, targets, bucket_rows):
    used, shares = mix(pages, targets, bucket_rows=bucket_rows)
    rows = used.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.copies <= {"big": 1, "small": 3}[r.source] for r in rows)
    report = {r.source: r for r in shares.collect()}
    assert set(report) == {"big", "small", "none"} and report["none"].reached_share == 0
    longest = max(r.n_tokens for r in rows)
    total = sum(r.used_tokens for r in report.values())
    for name, share in (("big", 0.5 / 0.95), ("small", 0.45 / 0.95)):
        assert abs(report[name].used_tokens - share * total) <= 2 * longest and report[name].most_copies <= report[name].max_repeats
    again = mix(pages.orderBy(F.desc("doc_id")), targets, bucket_rows=bucket_rows)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows}


def test_total_beyond_the_caps_and_empty_tables(pages, targets):
    _, shares = mix(pages, targets, total=10**9)
    report = {r.source: r for r in shares.collect()}
    assert report["big"].used_tokens == report["big"].n_tokens and report["small"].used_tokens == 3 * report["small"].n_tokens
    used, shares = mix(pages.limit(0), targets)
    assert used.count() == 0 and {r.reached_share for r in shares.collect()} == {0.0}
    used, shares = mix(pages, targets.limit(0))
    assert used.count() == 0 and shares.count() == 0
