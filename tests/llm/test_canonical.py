import random
import re

import numpy as np
import pytest

from vocabgraph.llm.bktree import BKTree, distance
from vocabgraph.llm.canonical import Matcher, Settings, best, comparable, map_names, strip


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(rng, n, low, high, letters="abc"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def test_distance():
    rng = random.Random(1)
    for a, b in zip(words(rng, 200, 0, 150), words(rng, 200, 0, 150, "abcd")):
        assert distance(a, b) == levenshtein(a, b)


def test_tree_finds_all_within_the_radius():
    rng = random.Random(2)
    keys, texts = words(rng, 300, 1, 9), words(rng, 200, 0, 12, "abcd") + ["x" * 100_000, ""]
    tree = BKTree(keys)
    radius = np.array([rng.randrange(4) for _ in texts])
    at, key, dist = tree.search(texts, radius)
    got = {(int(a), tree.keys[k]): int(d) for a, k, d in zip(at, key, dist)}
    want = {(i, k): d for i, t in enumerate(texts[:-2]) for k in set(keys) if (d := levenshtein(t, k)) <= radius[i]}
    want |= {(len(texts) - 1, k): len(k) for k in set(keys) if len(k) <= radius[-1]}
    assert got == want
    assert [len(x) for x in BKTree([]).search(["a"], np.array([3]))] == [0, 0, 0]


@pytest.mark.parametrize("low,high", [(1, 9), (0, 6), (60, 75)])
def test_radius_of_keys_and_classes(low, high):
    """Keys with a radius of their own, in classes; keys of more than one machine word; every key within both radii is found."""
    rng = random.Random(low)
    keys, texts = words(rng, 60, low, high), words(rng, 40, low, high + 3, "abcd")
    texts += [k[:3] + k[5:] for k in keys[:20]]
    own, kinds = {k: rng.randrange(4) for k in keys}, {k: k.count("a") % 2 for k in keys}
    asked = [rng.randrange(3) for _ in texts[:-20]] + [kinds[k] for k in keys[:20]]
    radius = np.array([rng.randrange(5) for _ in texts])
    tree = BKTree(keys, own, kinds)
    at, key, dist = tree.search(texts, radius, asked)
    got = {(int(a), tree.keys[k]): int(d) for a, k, d in zip(at, key, dist)}
    want = {(i, k): d for i, t in enumerate(texts) for k in set(keys) if kinds[k] == asked[i] and (d := levenshtein(t, k)) <= min(radius[i], own[k])}
    assert got == want and len(at) == len(got) and want


ENTRIES = [
    (1, "luruklun 5 mg ointment", None), (2, "luruklun 450 mg ointment", "LUN-95"), (3, "senior flaroxkai registrar", None), (4, "junior flaroxkai registrar", None), (5, "scalp stequounfenosis, type 1", None), (6, "scalp stequounfenosis, type 2", "SQN-77"), (7, "acute droudahiitis of the knee", None),
    (8, None, "ONLY-12"), (9, "", None), (10, "south vihigond hospice", None), (11, "upper vihigond hospice", None),
]
CASES = {
    "LURUKLUN  5 MGS OINT.": 1, "hx of Lurukln 5mg ointment": 1, "luruklun 20 mg ointment": None, "flaroxkai registrar, snr": 3, "jnr flaroxkai reg. ?": 4, "visiting flaroxkai registrar": None, "type 2, scalp stequnofenosis": 6, "SQN 77 [free text]": 6, "SQN-78": None, "KNEE acute droudahiitis o/ th": 7,
    "acutdroudahiitis of the knee": 7, "pt: ａｃｕｔｅ drоudahiitis of the knee (site entry)": 7, "only12": 8, "S. vihigond hospice": 10, "upr vihigond hospice - confirmed": 11, "see notes": None, "": None, "vihigond": None, "query": None, "x" * 200_000: None,
}


def match(matcher, texts):
    return matcher.match([strip(comparable(t), matcher.settings) for t in texts])


@pytest.mark.parametrize("text,entry", CASES.items(), ids=[k[:20] for k in CASES])
def test_names(text, entry):
    assert best(match(Matcher(ENTRIES, Settings()), [text])[0])[0] == entry


def test_ties_name_no_entry():
    twins = [(1, "abcdef clinic", None), (2, "abcdeg clinic", None)]
    found = best(match(Matcher(twins, Settings()), ["abcde clinic"])[0])
    assert found[0] is None
    same = [(1, "abcdef clinic", None), (2, "ABCDEF  clinic", None)]
    assert best(match(Matcher(same, Settings()), ["abcdef clinic"])[0]) == (None, 0, 2)


def test_frames_and_shards(spark):
    names = spark.createDataFrame([(t, i) for i, t in enumerate([*CASES, None] * 2)], "name string, text int")
    entries = spark.createDataFrame(ENTRIES + ENTRIES[:3] + [(None, "no id", None)], "canonical_id long, canonical_name string, short_form string")
    want = {t: i for t, i in CASES.items()}
    whole = {r.text: r.entry_id for r in map_names(names, "name", entries).collect()}
    assert whole == want
    # split by id, qualifiers of entries in other shards still lose to the closer entry
    shards = {r.text: r.entry_id for r in map_names(names, "name", entries, shard_entries=5).collect()}
    assert shards == want
    assert {r.entry_id for r in map_names(names, "name", entries.limit(0)).collect()} == {None}
    assert map_names(names.limit(0), "name", entries).count() == 0


@pytest.mark.parametrize("shard_entries", [1, 2, 5])
def test_shards_give_what_one_tree_gives(spark, shard_entries):
    """Qualifiers and rare words are those of the whole list, and no shard searches on where another one has an entry."""
    more = [(20 + i, f"{kind} plemtorra {place}", None) for i, (kind, place) in enumerate((k, p) for k in ("inner", "outer", "minor") for p in ("ward", "wing", "yard"))]
    more += [(40, "tabletka norvasil", None), (41, "tabka norvasil", None), (42, "ab cdefgh", None), (43, "abc defgh", None)]
    texts = [*CASES, "inmer plemtorra ward", "iner plemtorra wing", "manor plemtorra yard", "other plemtorra yard", "plemtora ward, outer", "tabka norvasil", "tabkanorvasil", "tabkk norvasil", "abcdefgg"]
    names = spark.createDataFrame([(t,) for t in texts], "name string")
    entries = spark.createDataFrame(ENTRIES + ENTRIES[:3] + more, "canonical_id long, canonical_name string, short_form string")
    whole = {tuple(r) for r in map_names(names, "name", entries).collect()}
    assert {tuple(r) for r in map_names(names, "name", entries, shard_entries=shard_entries).collect()} == whole


def test_long_words_that_are_written_shorter():
    doses = [(1, "luruklun 5 mg ointment", None), (2, "luruklun 450 mg ointment", None)]
    found = match(Matcher(doses, Settings()), ["luruklun 450 milligrams ointment", "luruklun 5 milligrams ointment", "x" * 200_000])
    assert [best(m)[0] for m in found] == [2, 1, None]


def test_every_entry_within_the_threshold_by_brute_force():
    """The closest entry and how many share its distance, against all keys compared one by one."""
    rng = random.Random(8)
    pool = words(rng, 14, 3, 9, "abcde") + ["5", "12"]
    entries = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(2, 5))), None) for i in range(60)]
    matcher = Matcher(entries, Settings())
    texts = [" ".join(rng.sample(n.split(), len(n.split()))) for _, n, _ in entries]
    texts = [t[:k] + rng.choice("abx") + t[k + rng.randrange(2) :] for t in texts for k in [rng.randrange(len(t))]]
    keys = {("".join(ws[k:] + ws[:k]), tuple(ws[k:] + ws[:k]), i) for i, n, _ in entries for ws in [n.split()] for k in range(len(ws))}
    for text, got in zip(texts, matcher.match(texts)):
        forms = matcher.forms(text, False)
        want = {(i, d) for f in forms for k, parts, i in keys if (d := levenshtein(f, k)) <= matcher.allowed(parts) and sorted(re.findall(r"\d+", f)) == sorted(re.findall(r"\d+", k)) and not matcher.contradicted(f, parts, d)}
        if want:
            assert best(got) == best(list(want)) and set(got) == want
