import random

import numpy as np
import pytest

from vocabgraph.llm.quality import KINDS, STATS, begin, page_kinds, page_stats, statistics

COMMON = [frozenset({"the", "of", "and", "in"}), frozenset({"der", "und"})]


def test_statistics_by_hand():
    got = dict(zip(STATS, page_stats("The ship, and the sea.\nLot 12: 7 eggs\n\n| x |", COMMON)))
    assert got["n_words"] == 10 and got["common_share"] == 3 / 10 and got["ending_share"] == 1 / 3 and got["figure_line_share"] == 1 / 3
    solid = len("Theship,andthesea.Lot12:7eggs|x|")
    assert got["digit_share"] == pytest.approx(3 / solid) and got["symbol_share"] == pytest.approx(5 / solid) and got["words_per_line"] == pytest.approx(10 / 3)
    assert got["mean_word_length"] == pytest.approx((3 + 4 + 3 + 3 + 3 + 3 + 4 + 1) / 8)
    assert page_stats(None, COMMON) == page_stats("", COMMON) == page_stats(" \n ", COMMON) == [0.0] * len(STATS)
    assert page_stats("the " * 100_000, COMMON)[0] == 100_000


def page(kind, rng):
    word = lambda: "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    n = rng.randrange(15, 40)
    if kind == "prose":
        return "\n".join(" ".join(rng.choice(["the", "of", "and", word(), word()]) for _ in range(rng.randrange(6, 9))) + rng.choice(["", "", ",", "."]) for _ in range(n))
    if kind == "list":
        return "\n".join(f"- {word()} {word()}; {word().title()}" for _ in range(n))
    if kind == "table":
        return "\n".join(f"{word().title()}  {rng.randrange(99)}  {rng.randrange(99)}  {rng.random() * 9:.2f}" for _ in range(n))
    return "\n".join("".join(rng.choice("#*~^|-_=+{}[]") for _ in range(rng.randrange(5, 40))) for _ in range(n))


def test_kinds_of_pages(spark):
    rng = random.Random(3)
    truth = {i: rng.choices(KINDS, [12, 2, 2, 1])[0] for i in range(500)}
    rows = [(i, page(k, rng), "x") for i, k in truth.items()] + [(900, None, "x"), (901, "", "x"), (901, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, page_class string")
    words = spark.createDataFrame([("en", w) for w in ("the", "of", "and")] + [("de", "und"), (None, "der"), ("en", None)], "lang string, word string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(80)] * 2 + [(81, "riddle"), (10_000, "list"), (None, "list")], "doc_id long, page_class string")
    found = page_kinds(docs, words, labels).collect()
    assert len(found) == len(rows)
    held = [r for r in found if 80 <= r.doc_id < 900]
    assert sum(r.page_class == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.page_class for r in found if r.doc_id >= 900} == {"junk"}
    nameless = page_kinds(docs, words, labels.limit(0)).collect()
    assert {r.page_class for r in nameless if r.doc_id < 900} == {None} and {r.page_class for r in nameless if r.doc_id >= 900} == {"junk"}
    assert page_kinds(docs.limit(0), words, labels).count() == 0 and statistics(docs, words.limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        statistics(docs, words, max_common=1)


def test_expectation_maximization_raises_the_likelihood():
    rng = np.random.default_rng(0)
    stats = np.abs(rng.normal(0.3, 0.1, (300, len(STATS))))
    labels = [KINDS[i % 4] for i in range(300)]
    model = begin(stats, labels, np.zeros(len(STATS)), np.ones(len(STATS)), dict.fromkeys(KINDS, 2))
    x, values = model.standard(stats), []
    for _ in range(6):
        flat = model.moments(x)
        values.append(flat[0])
        model = model.updated(flat, 1e-6)
    assert values == sorted(values) and abs(model.weights.sum() - 1) < 1e-9
