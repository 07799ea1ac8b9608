"""One consistent form for text that looks the same: composition, width, spaces, ignorable characters, look-alike letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ё": "Ë", "Ї": "Ï",
}
GREEK_LIKE = {
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Letters of scripts that are seldom written beside Latin, and what Latin letter they look like.
OTHER_LIKE = {
    "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q", "յ": "j", "Տ": "S", "Օ": "O", "Լ": "L", "Ս": "U",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮖ": "I", "Ꮛ": "E", "Ꮞ": "4", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d",
    "ꓐ": "B", "ꓑ": "P", "ꓒ": "d", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲕ": "K", "Ⲏ": "H", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
}
# Latin letters beyond the alphabet, Greek and Cyrillic ones that only nearly look like another; exchanged in words otherwise of plain Latin letters.
NEAR_LIKE = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ǀ": "l", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "η": "n", "τ": "t", "ω": "w", "ϲ": "c", "ϳ": "j", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "п": "n", "г": "r", "ь": "b"}
# Punctuation drawn like an ASCII sign.
SIGN_LIKE = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "⁄": "/", "∕": "/", "∶": ":", "ː": ":", "˸": ":", "꞉": ":", "∗": "*", "․": ".", "∣": "|", "‚": ",", "ʼ": "'", "ʹ": "'"}
# Compatibility characters with a look of their own; they stay. (Superscripts, fractions and circled signs are told by their tags.)
OWN_LOOK = set("№℡™℠µſ")
LIKE_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>")

_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_JOINER_SCRIPTS = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Sinhala}\p{Emoji_Presentation}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LATIN = regex.compile(r"\p{Latin}")
_SPACES = regex.compile(r"[\p{Zs}\p{Zl}\p{Zp}\t\x0b\f\x85]")
_PLAIN_LATIN = regex.compile(r"[A-Za-z]")


def _single(ch: str) -> str:
    """What one character looks like, where that is ordinary text."""
    if ch in SIGN_LIKE:
        return SIGN_LIKE[ch]
    if ch in OWN_LOOK or ch.isascii():
        return ch
    d = unicodedata.decomposition(ch)
    if not d.startswith("<"):
        return ch
    if d.startswith(("<wide>", "<narrow>")):  # a wide sign may itself be a sign drawn like another
        return "".join(SIGN_LIKE.get(c, c) for c in unicodedata.normalize("NFKC", ch))
    if not d.startswith(LIKE_TAGS):
        return ch
    plain = unicodedata.normalize("NFKC", ch)
    if "<compat>" in d and not all(c.isalpha() or c.isascii() for c in plain) or " " in plain:  # spacing accents and the like
        return ch
    return plain


def _near(word: str) -> str:
    """Letters of OTHER_LIKE and NEAR_LIKE exchanged, if every other letter of the word is a plain Latin one and there is at least one."""
    like = [c for c in word if c in OTHER_LIKE or c in NEAR_LIKE]
    if like and len(like) < len(word) and all(c in OTHER_LIKE or c in NEAR_LIKE or _PLAIN_LATIN.match(c) for c in word):
        return "".join(OTHER_LIKE.get(c) or NEAR_LIKE.get(c, c) for c in word)
    return word


def _script_words(text: str) -> str:
    """Look-alike letters of another script exchanged in words that aren't truly written in it.

    A word of more than one script is put in that of its letters without a double. A word wholly of Cyrillic or Greek letters that
    each look like a Latin one could be either: it is read as Latin if another word of the text is Latin and none is clearly of that
    script ('grade І'), and stays as it is if any is, or if no word is Latin ('сор').
    """
    words = _WORD.findall(text)
    cyr = lambda w: [c for c in w if "Ѐ" <= c <= "ԯ"]
    grk = lambda w: [c for c in w if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"]
    true_cyr = any(c not in CYRILLIC_LIKE for w in words for c in cyr(w) if not _LATIN.search(w))
    true_grk = any(c not in GREEK_LIKE for w in words for c in grk(w) if not _LATIN.search(w))
    any_latin = any(_LATIN.search(w) for w in words)

    def fix(m) -> str:
        w = m.group()
        for letters, like, true_elsewhere in ((cyr(w), CYRILLIC_LIKE, true_cyr), (grk(w), GREEK_LIKE, true_grk)):
            if not letters:
                continue
            own = [c for c in letters if c not in like]
            if _LATIN.search(w):
                if not own:
                    w = "".join(like.get(c, c) for c in w)  # a Latin word with borrowed letters
                else:
                    back = {v: k for k, v in like.items()}
                    latin = [c for c in w if _LATIN.match(c)]
                    if len(latin) < len(letters) and all(c in back for c in latin):
                        w = "".join(back.get(c, c) for c in w)  # the other way round
            elif not own and not true_elsewhere and any_latin:
                w = "".join(like.get(c, c) for c in w)
        return _near(w)

    return _WORD.sub(fix, text)


def consistent(text: str | None) -> str | None:
    """``text`` with every character exchanged or dropped that a reader wouldn't miss; letter case and plain spaces stay.

    Signs with a look of their own (², ½, ™, №), composed accented letters and words of another script stay.
    Null stays null and the empty text empty.
    """
    if text is None or text.isascii() and "\t" not in text and "\x0b" not in text and "\f" not in text:
        return text
    out = unicodedata.normalize("NFC", text)
    if not _JOINER_SCRIPTS.search(out):
        out = _IGNORABLE.sub("", out)
    else:
        out = regex.sub(r"[­​⁠﻿‎‏]+", "", out)
    out = _SPACES.sub(" ", out)
    out = "".join(map(_single, out))
    out = unicodedata.normalize("NFC", out)
    return _script_words(out)


def comparable(text: str | None) -> str | None:
    """The form for comparisons: consistent, then compatibility composed (NFKC), fully case folded, spaces collapsed and trimmed."""
    if text is None:
        return None
    out = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", consistent(text)).casefold())
    return " ".join(out.split())


def is_consistent(text: str | None) -> bool | None:
    return None if text is None else consistent(text) == unicodedata.normalize("NFC", text) == text


def per_distinct(function: Callable[[str | None], object], arrow: pa.DataType) -> Callable[[Iterator], Iterator]:
    """Adds column 'value' = function(text) to Arrow batches, computed once per distinct text of a batch."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(batch.schema.get_field_index("_text")).dictionary_encode()
            done = pa.array([function(x) for x in coded.dictionary.to_pylist()], arrow)
            others = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in others] + [done.take(coded.indices)], [*others, "_value"])

    return apply


def _with(df: DataFrame, column: str, out: str, function, arrow: pa.DataType, spark_type: T.DataType) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{column}`").alias("_text"))
    schema = T.StructType([*[T.StructField(f"c{i}", renamed.schema[f"c{i}"].dataType) for i in range(len(kept))], T.StructField("_value", spark_type)])
    return renamed.mapInArrow(per_distinct(function, arrow), schema).toDF(*kept, out)


def with_consistent(df: DataFrame, column: str, out: str = "consistent") -> DataFrame:
    """``df`` plus ``out``, the consistent form of ``column``. A column named ``out`` is replaced; null stays null."""
    return _with(df, column, out, consistent, pa.string(), T.StringType())


def with_comparable(df: DataFrame, column: str, out: str = "comparable") -> DataFrame:
    """``df`` plus ``out``, the folded form in which equal-looking texts are equal. A column named ``out`` is replaced; null stays null."""
    return _with(df, column, out, comparable, pa.string(), T.StringType())


def inconsistent(df: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose text is not in consistent form. Null and empty texts are; plain ASCII never leaves the JVM."""
    odd = df.where(F.col(column).rlike(r"[^\x20-\x7e]"))
    return _with(odd, column, "_ok", is_consistent, pa.bool_(), T.BooleanType()).where("NOT _ok").drop("_ok")
