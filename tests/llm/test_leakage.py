import random

import pytest

from vocabgraph.llm import leakage
from vocabgraph.llm.leakage import Item, Passages, Rules, align, chained, drop_leaks, find_leaks, page_tokens, reading_order

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(900)]


def prose(n, seed):
    own = random.Random(seed)
    return [own.choice(VOCABULARY) for _ in range(n)]


PASSAGE = prose(70, 1)


def lines(words, width=7, broken=True):
    out = []
    for i in range(0, len(words), width):
        out.append(" ".join(words[i : i + width]))
    if broken and len(out) > 1:  # break the first word of the second line over the line end
        first, rest = out[1].split(" ", 1)
        out[0], out[1] = f"{out[0]} {first[:2]}-", f"{first[2:]} {rest}"
    return out


def box(column, row):
    return (100 + 600 * column, 100 + 30 * row, 500 + 600 * column, 124 + 30 * row, 0.9)


def case(page_lines, boxes=None):
    found = Passages([(1, " ".join(PASSAGE)), (2, " ".join(prose(70, 2)))], Rules())
    text = "\n".join(page_lines)
    return [i for i, *_ in found.verify(text, boxes, found.candidates(text))]


def misread(words, share, seed):
    own = random.Random(seed)
    swap = {"o": "0", "l": "1", "e": "c", "s": "ſ", "n": "u", "m": "rn", "d": "cl", "a": "o"}
    return ["".join(swap.get(c, c) if own.random() < share else c for c in w) for w in words]


def test_whole_part_and_short():
    around = prose(60, 3), prose(60, 4)
    page = lambda part: lines(around[0] + part + around[1])
    assert case(page(PASSAGE)) == [1] and case(page(PASSAGE[20:45])) == [1] and case(page(PASSAGE[30:51])) == [1]
    assert case(page(PASSAGE[20:35])) == [] and case(page([])) == [] and case([""]) == []


def test_order_matters():
    shuffled = PASSAGE[:]
    random.Random(1).shuffle(shuffled)
    assert case(lines(shuffled)) == []
    backward = [w for k in range(63, -1, -7) for w in PASSAGE[k : k + 7]]
    assert case(lines(backward)) == []
    replaced = [prose(1, i)[0] if i % 4 == 3 else w for i, w in enumerate(PASSAGE)]
    assert case(lines(replaced)) == []


def test_misreadings_case_and_adverts():
    assert case(lines([w.upper() + "," for w in PASSAGE])) == [1]
    assert case(lines(misread(PASSAGE[10:50], 0.1, 2))) == [1]
    advert = lines(PASSAGE[:35], broken=False) + ["GRAND SALE of treacle, salt and", "candles. Terms cash."] + lines(PASSAGE[35:], broken=False)
    assert case(advert) == [1]
    cut = lines(PASSAGE[10:24], broken=False) + ["GRAND SALE of treacle, salt and"] + lines(PASSAGE[24:38], broken=False)
    assert case(cut) == [1]


def test_columns_read_across():
    left, right = lines(prose(70, 7)), lines(PASSAGE)
    mixed, boxes = [], []
    for row in range(max(len(left), len(right))):
        for column, part in enumerate((left, right)):
            if row < len(part):
                mixed.append(part[row])
                boxes.append(box(column, row)[:3])
    assert [mixed[i] for i in reading_order(mixed, boxes)] == left + right
    assert case(mixed, boxes) == [1]
    assert reading_order(["a", "b"], None) == [0, 1] and reading_order(["a", "b"], [None, None]) == [0, 1] and reading_order(["a"], [None, None]) == [0]


def test_alignment_counts_passage_words():
    tokens = page_tokens(lines(PASSAGE))
    assert align(Item(" ".join(PASSAGE)), *tokens)[:2] == (70, 70)
    assert align(Item(""), *tokens)[0] == 0 and align(Item("a"), *page_tokens([]))[0] == 0


@pytest.mark.parametrize("max_words", [2_000_000, 100])
def test_frames(spark, max_words):
    leak = "\n".join(lines(prose(40, 5)) + lines(PASSAGE) + lines(prose(40, 6)))
    long = "\n".join(lines(prose(20_000, 11), broken=False) + lines(PASSAGE) + lines(prose(9_000, 12), broken=False))
    pages = [(1, leak), (2, "\n".join(lines(prose(90, 8)))), (3, None), (4, ""), (5, long), (None, leak), (6, leak), (6, leak)]
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in pages], "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, item_id string")
    items = spark.createDataFrame([(1, " ".join(PASSAGE), "x"), (1, " ".join(PASSAGE), "x"), (2, None, "x"), (3, "", "x"), (None, "y", "x"), (4, " ".join(prose(70, 2)), "x")], "item_id long, passage string, text string")
    found = find_leaks(docs, items, max_words=max_words).collect()
    assert sorted((r.item_id, r.doc_id) for r in found) == [(1, 1), (1, 5), (1, 6), (1, 6)] and all(r.run == 70 for r in found)
    leaks = find_leaks(docs, items)
    assert {r.doc_id for r in drop_leaks(docs, leaks).collect()} == {2, 3, 4, None}
    cut = {r.doc_id: r.text for r in drop_leaks(docs, leaks, spans_only=True).collect()}
    kept = lines(prose(40, 5)) + lines(prose(40, 6))
    assert cut[1].split("\n") == kept and cut[4] == "" and cut[3] is None
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs, items, boxes=None).count() == 4


def spoiled(words, every, seed):
    return [prose(1, seed + i)[0] if i % every == every - 1 else w for i, w in enumerate(words)]


def test_clean_stretch_of_a_bad_run():
    long = prose(90, 31)

    def found(page):
        passages = Passages([(1, " ".join(long))], Rules())
        return [(i, at) for i, _, _, at in passages.verify("\n".join(page), None, [1])]

    for page in (long[:25] + spoiled(long[25:85], 4, 500), spoiled(long[:60], 4, 600) + long[60:85], spoiled(long[:32], 4, 700) + long[32:57] + spoiled(long[57:], 4, 800)):
        assert [i for i, _ in found(lines(prose(40, 32) + page + prose(40, 33)))] == [1]
    assert found(lines(spoiled(long, 4, 900))) == []


def test_clean_copy_beside_a_near_copy():
    long = prose(90, 41)
    bad, clean, between = lines(spoiled(long, 4, 950), broken=False), lines(long[40:63], broken=False), lines(prose(200, 42), broken=False)
    for page in (bad + between + clean, clean + between + bad, bad + clean, clean + bad):
        passages = Passages([(1, " ".join(long))], Rules())
        (_, run, seen, at), = passages.verify("\n".join(page), None, [1])
        assert run >= 20 and seen >= 0.88 * run and {page.index(x) for x in clean[1:-1]} <= set(at)
    both = lines(long[:30], broken=False) + between + lines(long[:30], broken=False)
    (_, run, _, at), = Passages([(1, " ".join(long))], Rules()).verify("\n".join(both), None, [1])
    assert run == 30 and set(at) == {*range(5), *range(len(both) - 5, len(both))}


def test_long_interruptions_on_long_pages():
    foreign = lines(prose(6_000, 51), broken=False)
    halves = lines(PASSAGE[:14], broken=False), lines(PASSAGE[14:28], broken=False)
    for page in (halves[0] + foreign[:570] + halves[1], halves[0] + foreign + halves[1], foreign + halves[0] + foreign[:150] + halves[1] + foreign):
        (i, run, _, at), = Passages([(1, " ".join(PASSAGE))], Rules()).verify("\n".join(page), None, [1])
        assert (i, run, at) == (1, 28, [x for x, text in enumerate(page) if text in halves[0] + halves[1]])


def test_chains_of_many_hits():
    own = random.Random(61)

    def plainly(hits, n, least):
        hits = sorted(hits)
        value, first = [n] * len(hits), list(range(len(hits)))
        for a, (k, j) in enumerate(hits):
            for b, (x, y) in enumerate(hits[:a]):
                if 0 < k - x <= 5 * n and y < j and (worth := value[b] + min(k - x, n) - (0 if abs(j - y - k + x) <= 2 else 2)) > value[a]:
                    value[a], first[a] = worth, first[b]
        return max(value) >= least

    for _ in range(200):
        hits = {(own.randrange(30), own.randrange(60)) for _ in range(own.randrange(1, 40))}
        for least in range(3, 30, 3):
            assert bool(chained(list(hits), 3, least)) == plainly(hits, 3, least)


def test_pages_are_aligned_together(monkeypatch):
    own = random.Random(71)
    texts = {i: prose(own.randrange(21, 120), 1000 + i) for i in range(6)}
    pages = []
    for d in range(40):
        part = []
        for i in own.sample(range(6), own.randrange(4)):
            a = own.randrange(len(texts[i]) - 20)
            part += misread(texts[i][a : a + own.randrange(15, 60)], 0.04, d) + prose(own.randrange(30), 2000 + d)
        pages.append((d, "\n".join(lines(prose(20, 3000 + d) + part)), None, list(texts)))
    passages = Passages([(i, " ".join(ws)) for i, ws in texts.items()], Rules())
    alone = [(i, d, *case) for d, text, _, items in pages for i, *case in passages.verify(text, None, items)]
    fills, settle = [], leakage.settle
    monkeypatch.setattr(leakage, "settle", lambda sheets, rules: fills.append(len(sheets)) or settle(sheets, rules))
    for held, least in ((leakage.TOGETHER, 20), (80_000, 4)):
        fills.clear()
        monkeypatch.setattr(leakage, "TOGETHER", held)
        assert sorted(passages.verify_all(pages)) == sorted(alone) and len(alone) > 20
        assert max(fills) >= least and (len(fills) > 1) == (held < 2_000_000)  # page by page there are no more than three
