import pytest

from vocabgraph.llm.lookalike import comparable, consistent, inconsistent, is_consistent, with_comparable, with_consistent

DIRTY = {
    "Vinou\xa0graft": "Vinou graft", "ｓｅｌｆ－ｌｉｍｉｔｉｎｇ": "self-limiting", "deﬁciency": "deficiency", "Grévin": "Grévin", "f﻿racture": "fracture", "Кlοkea": "Klokea", "Мild": "Mild", "stage Ⅱ": "stage II", "self‑limiting": "self-limiting", "post−touclan": "post-touclan",
    "IIІ": "III", "шкaф": "шкаф", "grade І": "grade I", "a b　c": "a b c", "soft­hyphen": "softhyphen", "Ångvik": "Ångvik", "zero​width": "zerowidth",
    "ɡastritis": "gastritis", "dıabetes": "diabetes", "օtitis": "otitis", "ꓮcute": "Acute", "Ꭺcute pain": "Acute pain", "ηeuron": "neuron", "кnee": "knee", "hipː left": "hip: left", "a\u2028b": "a b",
}
CLEAN = ["", "сор", "Щека с сор", "Ꭰ", "օձ հայ", "ⲟⲩⲟⲛ", "kнопка", "колено hip", "hip колено", "ηλεκτρο", "кость", "plain  name", "Simple m²", "(½ dose)", "ulcer ™", "№ 17", "44 °C", "δάσος και φως 7", "Ψυγείο Δ", "Щека и шея", "左膝の痛み", "発熱 12", "Grévin", "Ångvik", "≥ 41", "a → b", "Mixed (жёлтый щиток)", "Møltke", "12 µg", "نمی‌خواهم"]


@pytest.mark.parametrize("text,form", DIRTY.items())
def test_dirty(text, form):
    assert not is_consistent(text) and consistent(text) == form and is_consistent(form)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert is_consistent(text) and consistent(text) == text


def test_folding():
    assert comparable("  STRASSE  x") == comparable("Straße x") == "strasse x" and comparable(None) is None and consistent(None) is None
    assert comparable("ﬁn") == "fin" and comparable(comparable("ΣΊΣΥΦΟΣ ＡＢ")) == comparable("ΣΊΣΥΦΟΣ ＡＢ")


def test_frames(spark):
    texts = [*DIRTY, *CLEAN, None, "x​" * 50_000]
    df = spark.createDataFrame([(i, t, "clash", "z") for i, t in enumerate(texts * 2)], "id long, name string, _ok string, consistent string")
    bad = {r.id % len(texts) for r in inconsistent(df.drop("_ok"), "name").collect()}
    assert bad == {i for i, t in enumerate(texts) if t is not None and not is_consistent(t)}
    out = with_consistent(df, "name").collect()
    assert len(out) == len(texts) * 2 and all(r.consistent == consistent(texts[r.id % len(texts)]) for r in out)
    assert {r.comparable for r in with_comparable(df.where("name = ''"), "name").collect()} == {""}
    assert inconsistent(df.limit(0), "name").count() == 0 and with_consistent(df.limit(0), "name").columns == ["id", "name", "_ok", "consistent"]
