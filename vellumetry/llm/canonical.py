"""One form for texts that look the same (problem 6).

Method: normalization quick check. A table made from the Unicode properties says which code points
can change (NFC_QC of No or Maybe, marks out of order, width forms, ligatures, invisible characters,
odd spaces and hyphens, look-alike letters). A compiled class finds the unstable stretches, each
taken with the base character before it as boundary context; only these are normalised, and the
results are spliced into the unchanged text. Plain ASCII never gets past one C-level test.

Compatibility characters that look different (fractions, numero signs, circled or raised digits)
keep their form: this is not NFKC. Joiners count as a difference beside letters of Indic and Arabic
scripts (they change the shape there) and between emoji; elsewhere they are invisible.

The canonical form is for comparing: a Cyrillic word of nothing but look-alikes becomes Latin in it.
tidied() is for reading: there, words are only made Latin where they stand among Latin letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumetry.session import stored

# Look-alike letters of Greek and Cyrillic and the Latin letters they look like.
LOOKALIKE_FROM = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνАВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԜԝҮһӀӏ"
LOOKALIKE_TO = "ABEZHIKMNOPTYXocjvABESIJKMHOPCTYXaeopcyxsijhdqWwYhIl"
# Invisible characters; joiners are apart, as they are no noise everywhere.
INVISIBLE = "­͏؜᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
SELECTORS = "".join(map(chr, range(0xFE00, 0xFE10)))
JOINERS = "‌‍"
# Hyphens that look like the ASCII one.
HYPHENS = "‐‑﹣－"

#: Blocks whose letters joiners reshape: Devanagari to Malayalam and Sinhala; Arabic, Syriac and what follows them; Mongolian.
RESHAPED = "ऀ-෿\u0600-\u08ff\u1800-\u18af\ufb50-\ufdff\ufe70-\ufefe"
#: Entries a worker keeps of segments it has normalised; one entry is a few characters.
MEMO = 200_000


@cache
def _tables() -> tuple[dict[str, str], re.Pattern, re.Pattern, re.Pattern]:
    """What each character becomes by itself; patterns of those, of stretches NFC may change, of words with look-alikes."""
    fold: dict[str, str] = {}
    maybe: set[str] = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # Hangul vowels and finals
    no: set[str] = set()
    marks: set[str] = set()
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        d = ud.decomposition(c)
        if d:
            if d[0] != "<":
                parts = [chr(int(x, 16)) for x in d.split()]
                if ud.normalize("NFC", c) != c:
                    no.add(c)
                elif len(parts) == 2:
                    maybe.add(parts[1])
            elif d.startswith(("<wide>", "<narrow>")) or 0xFB00 <= o <= 0xFB06 or o in (0x132, 0x133, 0x1C4, 0x1C5, 0x1C6, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC):
                fold[c] = ud.normalize("NFKC", c)
        if ud.category(c) == "Zs" and c != " ":
            fold[c] = " "
        if ud.combining(c):
            marks.add(c)
    fold |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(INVISIBLE + SELECTORS, "")

    def class_of(chars: set[str]) -> str:
        out, run = [], []
        for o in sorted(map(ord, chars)):
            if run and o == run[-1] + 1:
                run.append(o)
                continue
            if run:
                out.append((run[0], run[-1]))
            run = [o]
        out.append((run[0], run[-1]))
        return "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in out)

    changing = re.compile(f"[{class_of(set(fold))}]")
    unstable, mark = class_of(maybe | no), class_of(marks | maybe)
    # the base before as context, then a stretch that doesn't surely stay as it is
    stretch = re.compile(f"[^\\x00-\\x1f{mark}]?[{mark}]+|[{unstable}][{mark}]*")
    words = re.compile(f"[^\\W\\d_]*[{LOOKALIKE_FROM}][^\\W\\d_]*")
    return fold, changing, stretch, words


_LOOK = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True))
_JOINER = re.compile(f"(?<![{RESHAPED}{JOINERS}\U0001f000-\U0001ffff☀-➿️])[{JOINERS}]+(?![{RESHAPED}\U0001f000-\U0001ffff☀-➿])")
_memo: dict[str, str] = {}
_word_memo: dict[str, str] = {}


def _segment(m: re.Match) -> str:
    s = m.group()
    got = _memo.get(s)
    if got is None:
        got = ud.normalize("NFC", s)
        if len(_memo) < MEMO:
            _memo[s] = got
    return got


def _nfc(text: str) -> str:
    """NFC, by way of the quick check: a text that passes is returned as it is, of others only the stretches in doubt are made anew."""
    return text if ud.is_normalized("NFC", text) else _tables()[2].sub(_segment, text)


def _word(m: re.Match) -> str:
    """A word with look-alikes becomes Latin, unless it has letters that only its own script has."""
    s = m.group()
    got = _word_memo.get(s)
    if got is None:
        got = s.translate(str.maketrans(_LOOK))
        if any(c in "Ͱ" or "Ͱ" <= c <= "ԯ" for c in got):
            got = s
        if len(_word_memo) < MEMO:
            _word_memo[s] = got
    return got


_MIX = re.compile("[Ͱ-ԯ]")


_UNIQUE = re.compile(f"(?![{LOOKALIKE_FROM}])[Ͱ-ԯ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def _word_among(line: str) -> Callable[[re.Match], str]:
    """Like _word, for words of a line that may be Latin: those with a Latin letter, and all where the line has Latin letters and none of another script's own."""
    latin_line = bool(_LATIN.search(line)) and not _UNIQUE.search(line)
    return lambda m: _word(m) if latin_line or _LATIN.search(m.group()) else m.group()


def _form(text: str | None, careful: bool) -> str | None:
    if text is None or text.isascii():
        return text if text is None or "\r" not in text else text.replace("\r\n", "\n").replace("\r", "\n")
    fold, changing, _, words = _tables()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if changing.search(text):
        text = changing.sub(lambda m: fold[m.group()], text)
    if "\u200c" in text or "\u200d" in text:
        text = _JOINER.sub("", text)
    text = _nfc(text)
    if _MIX.search(text):
        if careful:
            text = "\n".join(words.sub(_word_among(line), line) if _MIX.search(line) else line for line in text.split("\n"))
        else:
            text = words.sub(_word, text)
        text = _nfc(text)  # an accent may now stand on a Latin letter
    return text


def canonical(text: str | None) -> str | None:
    """The canonical form of a text, for comparing; null stays null and the empty text empty.

    Idempotent, and independent of how a text is cut at safe boundaries. Line ends are unified.
    """
    return _form(text, False)


def tidied(text: str | None) -> str | None:
    """A text in one form to read: as canonical(), but words of other scripts' letters stay as they are where no Latin ones are around."""
    return _form(text, True)


@F.arrow_udf(T.StringType())
def canonical_udf(texts: pa.Array) -> pa.Array:
    return pa.array([canonical(t) for t in texts.to_pylist()], pa.string())


def same_look_pairs(texts: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """Pairs (id_a < id_b) of rows whose texts differ but have one canonical form.

    Columns: {id_col}_a, {id_col}_b. Rows with null text make no pair; rows with equal texts make
    none with each other; repeated rows with the same id count once; other columns are ignored.
    Groups are formed on classes of equal text, so copies are never joined with each other: a class
    of a third of all rows costs its own rows plus the pairs the result must have.
    """
    base = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null and _id is not null")
    keyed = base.select("_id", _digest("_t").alias("h"), canonical_udf("_t").alias("_c")).select("_id", "h", _digest("_c").alias("k"))
    keyed = stored(keyed, "p6-keyed")  # digests only; the texts are made canonical once
    # forms that more than one text has; partial aggregation keeps hot forms cheap
    mixed = keyed.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("k")
    members = stored(keyed.join(mixed, "k", "left_semi").distinct(), "p6-members")
    classes = members.select("k", "h").distinct()
    pairs = (
        classes.select("k", F.col("h").alias("ha"))
        .join(classes.select("k", F.col("h").alias("hb")), "k")
        .where("ha < hb")
        .select("ha", "hb")
    )
    ids = members.select("_id", "h")
    left = pairs.join(ids.select(F.col("h").alias("ha"), F.col("_id").alias("a")), "ha").select("hb", "a")
    both = left.join(ids.select(F.col("h").alias("hb"), F.col("_id").alias("b")), "hb")
    return (
        both.where("a <> b")
        .select(F.least("a", "b").alias(f"{id_col}_a"), F.greatest("a", "b").alias(f"{id_col}_b"))
        .distinct()
    )


def _digest(column: str) -> Column:
    """128 bits: two seeds of a 64-bit hash."""
    return F.struct(F.xxhash64(F.lit(1), column).alias("x"), F.xxhash64(F.lit(2), column).alias("y"))
