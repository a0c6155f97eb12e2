"""One consistent form for text that looks alike but is stored differently.

``canonical_form`` keeps what a reader sees (case, accents, foreign words) and
replaces only what can't be told apart or seen; ``comparison_key`` goes on to
compatibility composition and full case folding, so that equal keys mean equal
text. Both run once per distinct value of a batch; plain ASCII never enters
Python's character tables.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that look like these Latin letters.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ѵ": "v", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ɡ": "g", "ɑ": "a", "ǃ": "!",
}
# Hyphens that look like the plain one, and signs drawn like a full stop.
_SIGNS = {"‐": "-", "‑": "-", "․": ".", "﹣": "-", "－": "-"}
# The ranges of characters that Unicode calls default-ignorable.
_IGNORABLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Joiners, and scripts whose letters they shape.
_JOINERS = "\u200c\u200d"
_JOINED_SCRIPTS = {
    "ARABIC", "SYRIAC", "MONGOLIAN", "NKO", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR", "TIBETAN",
}
_SHAPED = re.compile(f"(?<=[^\\x00-\\x7F])[{_JOINERS}](?=[^\\x00-\\x7F])")
# Letters of one script that serve as symbols in words of another.
_SYMBOL_LETTERS = set("μδµ")

#: Anything but these may need attention; texts without it are as they should be.
_ODD = re.compile(r"[^\x00-\x7F¡-¬®-ıĴ-ľŁ-ňŊ-žƀ-ƒδμ–—“”‘’„‚«»…°′″×±≤≥≈→•†‡€™]")

_LOOKALIKE_SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "COPTIC")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@functools.lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    """The script of a letter by its Unicode name: LATIN, CYRILLIC, ..."""
    name = unicodedata.name(ch, "")
    return "GREEK" if name.startswith("COPTIC") else name.split(" ", 1)[0]


@functools.lru_cache(maxsize=65536)
def _plain(ch: str) -> str:
    """What a single character stands for irrespective of its word."""
    o = ord(ch)
    if o < 0x7F:
        return ch
    if any(a <= o <= b for a, b in _IGNORABLE_RANGES):
        return ""
    if ch in _SIGNS:
        return _SIGNS[ch]
    if ch in "  \x85":
        return "\n"
    if unicodedata.category(ch) == "Zs":
        return " "
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>", "<font>")) or (tag.startswith("<compat>") and unicodedata.category(ch)[0] in "LN"):
        return unicodedata.normalize("NFKC", ch)
    return ch


def _words(text: str) -> str:
    """``text`` with foreign look-alikes in words of Latin letters, and Latin ones
    in words of another script, put right."""
    latin_around = None
    out, at = [], 0
    for m in _WORD.finditer(text):
        word = m.group()
        if word.isascii():
            continue
        scripts = {_script(c) for c in word if c not in _SYMBOL_LETTERS and unicodedata.category(c)[0] == "L"}
        foreign = scripts & set(_LOOKALIKE_SCRIPTS)
        fixed = word
        if "LATIN" in scripts and foreign:
            latin = sum(_script(c) == "LATIN" for c in word)
            unlike = [c for c in word if _script(c) in foreign and c not in _LOOKALIKES and c not in _SYMBOL_LETTERS]
            if unlike and len(unlike) >= latin:
                fixed = "".join(_to_script(c, next(iter(sorted(foreign)))) for c in word)
            else:
                fixed = "".join(_LOOKALIKES.get(c, c) for c in word)
        elif foreign and "LATIN" not in scripts and all(c in _LOOKALIKES or unicodedata.category(c)[0] != "L" for c in word):
            if latin_around is None:
                words = _WORD.findall(text)
                latin_around = sum(_script(c) == "LATIN" for w in words for c in w) > sum(_script(c) in _LOOKALIKE_SCRIPTS and c not in _LOOKALIKES and c not in _SYMBOL_LETTERS for w in words for c in w)
            if latin_around:
                fixed = "".join(_LOOKALIKES.get(c, c) for c in word)
        elif "LATIN" in scripts:
            fixed = "".join(_LOOKALIKES.get(c, c) if _script(c) == "LATIN" else c for c in word)
        if fixed != word:
            out.append(text[at : m.start()])
            out.append(fixed)
            at = m.end()
    return text if not out else "".join(out) + text[at:]


def _to_script(ch: str, script: str) -> str:
    """The letter of ``script`` that looks like the Latin letter ``ch``."""
    return _REVERSE.get((script, ch), ch)


_REVERSE = {(_script(k), v): k for k, v in reversed(_LOOKALIKES.items()) if _script(k) != "LATIN"}


def _kept_joiners(text: str) -> set[int]:
    """Where a joiner stands between two letters or marks of a script that it shapes."""
    return {m.start() for m in _SHAPED.finditer(text) if _script(text[m.start() - 1]) in _JOINED_SCRIPTS and _script(text[m.end()]) in _JOINED_SCRIPTS}


@functools.lru_cache(maxsize=8192)
def canonical(text: str) -> str:
    """The consistent form of one text; idempotent, and the text itself where
    nothing in it is out of the ordinary."""
    if text.isascii() or not _ODD.search(text):
        return text
    kept = _kept_joiners(text) if any(j in text for j in _JOINERS) else ()
    plain = "".join(c if i in kept else _plain(c) for i, c in enumerate(text)) if kept else "".join(map(_plain, text))
    return _words(unicodedata.normalize("NFC", plain))


def comparable(text: str) -> str:
    """Compatibility composition, full case folding and single spaces."""
    folded = unicodedata.normalize("NFKC", canonical(text)).casefold()
    return " ".join(unicodedata.normalize("NFKC", folded).split())


def _by_distinct(values: pd.Series, f) -> pd.Series:
    """``f`` of each value, computed once per distinct value."""
    codes, distinct = pd.factorize(values)
    done = [f(v) for v in distinct] + [None]
    return pd.Series([done[c] for c in codes], dtype="object")


@F.pandas_udf(StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return _by_distinct(values, canonical)


@F.pandas_udf(StringType())
def _comparable_udf(values: pd.Series) -> pd.Series:
    return _by_distinct(values, comparable)


def canonical_form(text: Column) -> Column:
    """The consistent form of ``text``; null stays null, empty stays empty."""
    return _canonical_udf(text)


def comparison_key(text: Column) -> Column:
    """A key that is equal for texts that look equal but for case and spacing."""
    return _comparable_udf(text)


def not_ascii(text: Column) -> Column:
    """True where a text has any character outside ASCII, decided in the JVM; such
    rows alone need the Python form."""
    return text.rlike(r"[^\x00-\x7F]")
