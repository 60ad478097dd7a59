"""One consistent form for text that looks the same: quick check, isolate, normalise, splice.

A regular expression derived from Unicode properties (NFC quick check, combining class, decomposition type) runs in the
JVM over all text. Only values that hold an unstable character reach Python; there only the words around unstable
characters are rewritten, with their neighbours as context, and spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, as "other letter, Latin letter" pairs.
LOOKALIKE_PAIRS = """
аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv ёë їï
АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ЅS ІI ЈJ ԌG ӀI ѴV ҮY ЁË ЇÏ
οo νv αa ιi κk ρp υu ϲc ϳj όó άá ίí
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϿJ
օo ոn սu հh ցg զq ՕO ՍU
ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᏔW ᏃZ
"""
# Latin-script and punctuation characters drawn like an ordinary one, as pairs.
ALWAYS_PAIRS = "ɡg ɑa ıi ‐- ‑- ․."
LOOKALIKE = {p[0]: p[1] for p in LOOKALIKE_PAIRS.split()}
ALWAYS = {p[0]: p[1] for p in ALWAYS_PAIRS.split()}
# Code points without a visible form that are not in category Cf, and visible ones that are.
INVISIBLE_EXTRA = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
VISIBLE_CF = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
EMOJI_JOINERS = "\u200d\ufe0f"


def _is_radical(code: int) -> bool:
    return 0x2E80 <= code <= 0x2FDF


@lru_cache(1)
def properties() -> tuple[dict[str, str], frozenset[str], frozenset[str]]:
    """(single-character replacements, invisible characters, characters that may compose with the one before)."""
    single, invisible, marks = {}, set(), {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for code in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if (kind == "Cf" and code not in VISIBLE_CF) or (kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x85\x1c\x1d\x1e\x1f") or code in INVISIBLE_EXTRA:
            invisible.add(ch)
        elif kind == "Zs" and ch != " ":
            single[ch] = " "
        elif ch in "\u2028\u2029":
            single[ch] = "\n"
        else:
            if kind in ("Mn", "Mc"):
                marks.add(ch)
            if form := unicodedata.decomposition(ch):
                tag = form[1:].partition(">")[0] if form[0] == "<" else ""
                composed, plain = unicodedata.normalize("NFC", ch), unicodedata.normalize("NFKC", ch)
                ascii_letters = (kind[0] == "L" or kind == "Nl") and plain.isascii() and plain.isalnum() and ch != "\u017f"
                han = len(plain) == 1 and "\u4e00" <= plain <= "\u9fff" and (kind == "Nl" or _is_radical(code))
                if composed != ch:
                    single[ch] = composed
                elif (tag in ("wide", "narrow", "font") and kind[0] in "LN") or (tag == "compat" and (ascii_letters or han)):
                    single[ch] = plain
    return single | ALWAYS, frozenset(invisible), frozenset(marks)


def _ranges(chars: set[str], java: bool = False) -> str:
    codes, out = sorted(map(ord, chars)), []
    show = (lambda c: f"\\x{{{c:X}}}") if java else (lambda c: f"\\U{c:08X}")
    first = last = codes[0]
    for code in [*codes[1:], sys.maxunicode + 1]:
        if code != last + 1:
            out.append(show(first) if first == last else f"{show(first)}-{show(last)}")
            first = code
        last = code
    return "".join(out)


@lru_cache(1)
def unstable_class() -> str:
    """Body of a character class with every character that may change."""
    single, invisible, marks = properties()
    return _ranges({*single, *invisible, *marks, *LOOKALIKE})


#: Blocks that nearly all text is written in, most frequent first.
COMMON_BLOCKS = ((0x20, 0x7E), (0x4E00, 0x9FFF), (0x3001, 0x303F), (0xFF01, 0xFF20), (0xA1, 0x17F), (0x2010, 0x203E), (0x09, 0x0D))


@lru_cache(1)
def stable_class() -> str:
    """Body of a short character class, for the JVM, of the characters of the common blocks that never change."""
    single, invisible, marks = properties()
    moving = {*single, *invisible, *marks, *LOOKALIKE}
    return "".join(_ranges({c for c in map(chr, range(low, high + 1)) if c not in moving}, java=True) for low, high in COMMON_BLOCKS)


@lru_cache(1)
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """(an unstable character and the rest of its word, a word of letters, digits and marks)."""
    marks = _ranges(set(properties()[2]))
    unstable = unstable_class()
    return re.compile(rf"[{unstable}][\w{unstable}]*"), re.compile(rf"(?:[^\W_]|[{marks}])+")


def _foreign(letters: str) -> str:
    """The script of a letter that is neither Latin nor Han, by the first word of its name."""
    return unicodedata.name(letters, "").split(" ")[0]


def _real_word(word: str, like: str) -> bool:
    """A word of the script of `like` that has letters without a Latin look-alike."""
    return any(c.isalpha() and c not in LOOKALIKE and _foreign(c) == _foreign(like) for c in word)


def _latin_word(word: str, before: str, after: str) -> str:
    """`word` with look-alikes made Latin where they stand in for Latin letters; real foreign words stay.

    Stand-ins: look-alikes in a word that also has Latin letters, and words of look-alikes alone unless a
    neighbouring word is a real one of the same script.
    """
    like = [c for c in word if c in LOOKALIKE]
    if not like:
        return word
    latin = any(c.isalpha() and c not in LOOKALIKE and _foreign(c) == "LATIN" for c in word)
    if not latin and (any(c.isalpha() and c not in LOOKALIKE for c in word) or any(_real_word(w, like[0]) for w in (before, after))):
        return word
    return unicodedata.normalize("NFC", "".join(LOOKALIKE.get(c, c) for c in word))


def _plain(piece: str) -> str:
    """Invisible characters removed (joiners inside emoji stay), single replacements and NFC applied."""
    single, invisible, _ = properties()
    out: list[str] = []
    for c in piece:
        if c in invisible:
            if c in EMOJI_JOINERS and out and (out[-1] in EMOJI_JOINERS or unicodedata.category(out[-1][-1]) in ("So", "Sk")):
                out.append(c)
            continue
        out.append(single.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def canonical(text: str) -> str:
    """The consistent form of `text`; unchanged segments are spliced through untouched."""
    segment, word = _patterns()
    parts, end = [], 0
    for m in segment.finditer(text):
        start, stop = m.span()
        while start > end and text[start - 1].isalnum():
            start -= 1
        if start == m.start() and start > end:
            start -= 1  # the character before is context for marks and joiners
        parts += [text[end:start], text[start:stop]]
        end = stop
    if not parts:
        return text
    parts.append(text[end:])
    joined = "".join(_plain(p) if i % 2 else p for i, p in enumerate(parts))
    if not any(c in LOOKALIKE for c in joined):
        return joined
    spans = list(word.finditer(joined))
    out, end = [], 0
    for i, m in enumerate(spans):
        if any(c in LOOKALIKE for c in m.group()):
            near = [spans[k].group() if 0 <= k < len(spans) else "" for k in (i - 1, i + 1)]
            out += [joined[end : m.start()], _latin_word(m.group(), *near)]
            end = m.end()
    return "".join(out) + joined[end:]


def canonical_whole(text: str) -> str:
    """`canonical` without isolation, for tests: the rules over the whole text."""
    joined = _plain(text)
    words = re.split(f"({_patterns()[1].pattern})", joined)
    return "".join(_latin_word(w, words[i - 2] if i >= 2 else "", words[i + 2] if i + 2 < len(words) else "") if i % 2 else w for i, w in enumerate(words))


@F.pandas_udf(T.StringType())
def _canonical_udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield texts.map(canonical, na_action="ignore")


def unstable(value: Column) -> Column:
    """The quick check: whether `value` holds a character that isn't known to be stable. Null for null."""
    return value.rlike(f"[^{stable_class()}]")


def with_canonical(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`rows` with the canonical form of each column in `columns` (source name to new name).

    Null stays null, empty stays empty; values of any length are rewritten whole; names must not clash.
    """
    for source, new in columns.items():
        value = F.col(f"`{source}`")
        rows = rows.withColumn(new, F.coalesce(_canonical_udf(F.when(unstable(value), value)), value))
    return rows


def found(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name) of each value that holds a look-alike or an invisible character."""
    long = rows.select(F.col(id_col), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("_f"))
    some = long.select(id_col, "_f.field_name", "_f.value").filter(unstable(F.col("value")))
    return some.filter(_canonical_udf("value") != F.col("value")).select(id_col, "field_name")
