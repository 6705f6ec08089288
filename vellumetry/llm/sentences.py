"""Sentences of texts in many languages and scripts (problem 1).

Method: cascading segmentation rule tables. Every rule is a pair of patterns, one for the text before
a position and one for the text after it, and says break or no break; the first rule whose two
patterns match decides. Tables exist for each language; a cascade puts the tables for a script in
order, with the common table last, and a position is decided by the cascade of the script before it.
Of the tables for languages with Latin letters, only that of the sentence's language is asked, where the
common words from its start to a little beyond the position, or the caller, tell it, else all are. Candidate positions are those after closing marks, and in
Thai, which has none, the spaces. Blank lines always break, and positions inside a closed pair of
quotes or brackets never do, so a quotation stays with the sentence that reports it.

Offsets count code points. Empty and blank texts have no sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.canonical import LOOKALIKE_FROM, LOOKALIKE_TO

LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
DEVANAGARI, BENGALI, THAI = "ऀ-ॣ०-ॿ", "ঀ-৿", "฀-๿"
JAPANESE = "぀-ヿ㐀-鿿々〆ｦ-ﾟ"
UPPER = "A-ZÀ-ÖØ-Þ"
OPENING = r"[\"'“„«‘(\[¿¡—–]"

# Abbreviations that a name, a number or the rest of a phrase follows, by language.
BEFORE_NAME = {
    "eng": "Mr Mrs Ms Messrs Dr Prof Capt Col Gen Lt Maj Sgt Cpl Rev Hon Sir St Gov Sen Rep Pres Supt Mt Ft",
    "fra": "MM Mme Mlle Mgr Me Dr Prof Ste St Vve",
    "deu": "Hr Hrn Fr Frl Dr Prof Ing Dipl St Hl",
    "lat": "S St",
    "spa": "Sr Sra Srta Sres Dr Dra D Dña Lic Ing Prof Sto Sta Fr Ud Uds Vd",
}
BEFORE_NUMBER = {
    "eng": "No Nos nos Fig Figs fig vol vols Vol p pp chap Chap lib cap Art art sec Sec ch ca c v vv l ll",
    "fra": "n no nos t vol p pp chap fig art liv col env",
    "deu": "Nr Nrn Bd Bde S Kap Abb Abs Art Aufl Jg ca Tab Taf Z Str",
    "lat": "lib cap pag fol vol a an",
    "spa": "núm núms pág págs vol t cap art fig",
}
# Abbreviations that only a number in digits follows: months, and words that also end sentences.
BEFORE_DIGIT = {
    "eng": "no Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec",
    "fra": "janv févr avr juil sept oct nov déc",
    "deu": "Jan Feb Febr Mrz Apr Jun Jul Aug Sept Sep Okt Nov Dez",
    "lat": "Ian Febr Mart Apr Iun Iul Aug Sept Oct Nov Dec",
    "spa": "ene feb abr jun jul ago sept set oct nov dic",
}
#: A number: digits, or a whole roman numeral, but no capital I by itself.
NUMERAL = r"\s*(?:\d|[ivxlc]+(?![^\W\d_])|(?:I(?=[IVXLC])|[VXLC])[IVXLC]*(?![^\W\d_]))"
WITHIN_PHRASE = {
    "eng": "e.g i.e viz cf vs al",
    "fra": "c.-à-d p.ex cf",
    "deu": "z.B z d.h d u.a u bzw vgl Vgl evtl ggf sog u.U i.A o.ä",
    "lat": "i.e i e.g cf sc",
    "spa": "p.ej p cf EE",
}
# Common words, by which a sentence's language is told.
COMMON_WORDS = {
    "eng": "the of and was with that this which from to for his by are were had",
    "fra": "le la les des une dans est que et du au pour par sur il qui",
    "deu": "der die das und nicht mit von ein ist im den dem eine zu war auf",
    "lat": "et in est ut cum ad non quod sed per ex ab autem tamen qui hoc",
    "spa": "el los las una con que por del se en la y para su al de",
}
# Words before a German ordinal.
GERMAN_ORDINAL = "im am vom zum zur der die das dem den des ab bis seit und Im Am Vom Zum Zur Der Die Das Dem Den Des Seit"
# Short Indic words written with a stop.
INDIC_SHORT = "ई पं डॉ श्री स्व प्रो कु सु क्र रु सं वि मो ডঃ ড ডা মো মোঃ খ্রি খ্রিঃ অধ্যা প্রফেসর নং কোং"
# Thai abbreviations, and words after which a space can't end a sentence.
THAI_INNER = "ฯลฯ พ.ศ. ค.ศ. ร.ศ. จ.ศ. น. ว่า เมื่อ และ หรือ ของ ที่ ใน จาก กับ แก่ โดย ซึ่ง อัน ดร. นาย นาง คุณ ศ. รศ. ผศ. ณ"
THAI_AFTER = "ฯลฯ พ.ศ. ค.ศ. แล้วก็ แล้วจึง และ หรือ บาท"

#: Break or no break, what stands before (None: anything), what stands after.
Rule = tuple[bool, re.Pattern | None, re.Pattern]


def _words(text: str) -> str:
    return "|".join(re.escape(w) for w in sorted(text.split(), key=lambda w: (-len(w), w)))


def _rule(is_break: bool, before: str, after: str = "") -> Rule:
    return is_break, None if before == "." else re.compile(f"(?:{before})\\Z"), re.compile(after)


@cache
def tables() -> dict[str, list[Rule]]:
    """The rule tables by name: a language, a script or 'common'."""
    out: dict[str, list[Rule]] = {}
    for lang in BEFORE_NAME:
        edge = f"(?<![{LATIN}\\d])"
        out[lang] = [
            _rule(False, f"{edge}(?:{_words(BEFORE_NAME[lang])})\\.", rf"\s*{OPENING}?[{UPPER}\d]"),
            _rule(False, f"{edge}(?:{_words(BEFORE_NUMBER[lang])})\\.", NUMERAL),
            _rule(False, f"{edge}(?:{_words(BEFORE_DIGIT[lang])})\\.", r"\s*\d"),
            _rule(False, f"{edge}(?:{_words(WITHIN_PHRASE[lang])})\\."),
        ]
    out["fra"].append(_rule(False, r"\d\s*(?:h|min)\.", r"\s*\d"))
    out["deu"].append(_rule(False, rf"(?<![{LATIN}])(?:{_words(GERMAN_ORDINAL)})\s+\d{{1,2}}\.", rf"\s*[{UPPER}]"))
    out["latin"] = [
        _rule(True, rf"[{LATIN}]{{3}}[.!?…]+|\d{{3}}\.|[!?]", rf"[{UPPER}][{LATIN}’]|[“„«¿¡‘(][{UPPER}¿¡]|[AO] "),  # the space is missing
        _rule(False, r".", r"\S"),
        _rule(False, r".", rf"\s*(?:{OPENING}\s*)*[a-zß-öø-ÿ]"),
        _rule(False, r".", r"\s*[.,;:)\]]"),
        _rule(False, rf"(?<![{LATIN}’])[{UPPER}]\.", rf"\s*[{UPPER}]"),  # an initial
        _rule(False, r"\.\s\.\s?\.?", rf"\s*[^{UPPER}]"),
    ]
    out["indic"] = [
        _rule(False, rf"(?<![{DEVANAGARI}{BENGALI}])(?:{_words(INDIC_SHORT)})\."),
        _rule(False, rf"[{DEVANAGARI}{BENGALI}]\.", r"\S"),
        _rule(False, r"\|", r"\S"),
        _rule(False, r"…", rf"\s*[{DEVANAGARI}{BENGALI}]"),
        _rule(False, r"[.!?]", r"\s*[.,;:)\]]"),
    ]
    out["hin"] = out["san"] = [_rule(False, r"\d\.", r"\s*\d")]
    out["ben"] = [_rule(False, r"ঃ\.", "")]
    out["jpn"] = [
        _rule(False, r"[.…]+", rf"\s*[{JAPANESE}\d]"),
        _rule(False, r"[」』）)]", r"\s*[とはがをにのもでへやな、，。」』]"),
        _rule(False, r"[。！？!?]", r"\s*[」』）)、，。！？]"),
    ]
    out["tha"] = [
        _rule(False, rf"(?:^|[^{THAI}])(?:{_words(THAI_INNER)})|ฯ|ว่า|\d|[,:;]|(?:พ|ค|ร|จ)\.ศ\.", ""),
        _rule(False, r"[”\"’)]", rf"\s*[{THAI}]"),
        _rule(False, r".", rf"\s*(?:{_words(THAI_AFTER)}|\d+(?:[.,]\d+)*\s*(?:บาท|คน|ตัว|ปี))"),
        _rule(False, r".", rf"\s*[{THAI}]+\s+ฯลฯ"),
        _rule(False, r".", r"\s*[“\"‘(]?\d"),
        _rule(False, r"[.!?]", r"\S"),
    ]
    out["common"] = [
        _rule(False, r"\d\.", r"\d"),
        _rule(False, r"[.!?…|]", r"[\w]"),
        _rule(True, r".", r""),
    ]
    return out


#: Cascades: the tables in the order they are asked, by script; "language" stands for a named language.
CASCADES = {
    "latin": ("eng", "fra", "deu", "lat", "spa", "latin", "common"),
    "devanagari": ("hin", "san", "indic", "common"),
    "bengali": ("ben", "indic", "common"),
    "japanese": ("jpn", "common"),
    "thai": ("tha", "common"),
}
SCRIPT_OF = {"eng": "latin", "fra": "latin", "deu": "latin", "lat": "latin", "spa": "latin", "hin": "devanagari", "san": "devanagari", "ben": "bengali", "jpn": "japanese", "tha": "thai"}


@cache
def cascade(script: str, language: str | None = None) -> tuple[tuple[Rule, ...], tuple[Rule, ...], re.Pattern]:
    """All rules of a cascade; those without the languages' own; and a gate: where it doesn't match, no language rule can."""
    names = CASCADES[script]
    if language and SCRIPT_OF.get(language) == script:
        names = tuple(n for n in names if n == language or n not in SCRIPT_OF)
    own = [r for n in names if n in SCRIPT_OF for r in tables()[n]]
    rest = [r for n in names if n not in SCRIPT_OF for r in tables()[n]]
    gate = re.compile("|".join(f"(?:{b.pattern})" if b else "" for _, b, _ in own) if own else r"(?!)")
    return (*own, *rest), tuple(rest), gate


_PARAGRAPH = re.compile(r"(?:\r\n?|\n)[^\S\n]*(?:(?:\r\n?|\n)[^\S\n]*)+")
_MARKS = re.compile(r"[.!?…।॥|。！？｡]+")
_THAI_SPACE = re.compile(rf"(?<=[{THAI}])\s+|(?<=[”\"’)\d])\s+(?=[{THAI}])")
_HAS_THAI = re.compile(f"[{THAI}]")
_PAIRS = re.compile(r"[“”„«»‘’「」『』()（）\"\[\]]")
_SCRIPT = re.compile(rf"([{LATIN}])|([{DEVANAGARI}])|([{BENGALI}])|([{JAPANESE}])|([{THAI}])")
_SCRIPTS = ("latin", "devanagari", "bengali", "japanese", "thai")
_CLOSES = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "["}
_LETTER = re.compile(rf"[{LATIN}]")
#: Characters of context that a rule sees before a position; none needs more.
CONTEXT = 20
#: Characters after a position that may tell its language.
AHEAD = 60
#: Forms of one character that stand for another, for the rules only; offsets stay.
_SAME = {**{0xFF01 + i: 0x21 + i for i in range(94) if 0xFF01 + i not in map(ord, "！（），．？")}, **dict(zip(map(ord, LOOKALIKE_FROM), LOOKALIKE_TO, strict=True))}
_OTHER_FORMS = re.compile("[" + "".join(map(chr, _SAME)) + "]")


def _pairs(text: str, lo: int, hi: int) -> dict[int, int]:
    """Closing position -> opening position of the outermost closed pairs of quotes and brackets."""
    stack: list[tuple[str, int]] = []
    done: dict[int, int] = {}
    for m in _PAIRS.finditer(text, lo, hi):
        c, i = m.group(), m.start()
        if c == "’":
            if i + 1 < hi and text[i + 1].isalpha() or not any(s == "‘" for s, _ in stack):
                continue  # an apostrophe
            want = "‘"
        elif c == "“" and any(s == "„" for s, _ in stack):
            want = "„"
        elif c == '"':
            # what opens follows a space or an opening mark, what closes doesn't; after a digit it may be a measure
            opens = i == lo or text[i - 1].isspace() or text[i - 1] in "([{—–-“„«‘"
            if not opens and not any(s == '"' for s, _ in stack):
                continue
            want = "" if opens else '"'
        else:
            want = _CLOSES.get(c, "")
        if not want:
            stack.append((c, i))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == want:
                done[i] = stack[k][1]
                del stack[k:]
                break
    return done


_PLAIN_WORD = re.compile(f"[{LATIN}]+")
_COMMON = {lang: frozenset(words.split()) for lang, words in COMMON_WORDS.items()}


def language_of(text: str) -> str | None:
    """The language of a stretch of text in Latin letters by its common words; None where they don't tell, or tell of two."""
    words = _PLAIN_WORD.findall(text.lower())
    (most, lang), (second, _), *_ = sorted(((sum(w in common for w in words), lang) for lang, common in _COMMON.items()), reverse=True)
    return lang if most >= 2 and most >= 2 * second else None


class _ScriptOf(dict):
    def __missing__(self, c: str) -> str | None:
        m = _SCRIPT.match(c)
        self[c] = out = _SCRIPTS[m.lastindex - 1] if m else None
        return out


_script_of = _ScriptOf()


def _script_at(text: str, i: int, lo: int) -> str:
    """The script of the last letter before i."""
    while i > lo:
        i -= 1
        if got := _script_of[text[i]]:
            return got
    return "latin"


_REPORTED = re.compile(rf"[\s]*[{DEVANAGARI}{BENGALI}]")


def _breaks(text: str, lo: int, hi: int, language: str | None) -> Iterator[int]:
    """The positions in a paragraph where a sentence ends, without the paragraph's own end."""
    closes = _pairs(text, lo, hi)
    spans = sorted((o, c) for c, o in closes.items())
    outer: list[tuple[int, int]] = []
    for o, c in spans:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    ends = [(m.end(), True) for m in _MARKS.finditer(text, lo, hi)]
    if _HAS_THAI.search(text, lo, hi):
        ends = sorted({*ends, *((m.start(), False) for m in _THAI_SPACE.finditer(text, lo, hi))})
    k, start, last = 0, lo, -1
    for p, marked in ends:
        if marked:
            while p < hi:  # closing quotes and brackets stay with the sentence
                q = p
                while q < hi and q - p < 2 and text[q] in " \u00a0\u202f\n":
                    q += 1
                if q in closes:
                    p = q + 1
                elif p in closes:
                    p += 1
                else:
                    break
        if p >= hi or p <= last:
            continue
        last = p
        if marked and p + 1 < hi and text[p].isspace() and text[p + 1].islower() and _script_at(text, p, lo) == "latin":
            continue  # what the tables say of a lower-case letter, without asking them
        while k < len(outer) and outer[k][1] < p:
            k += 1
        if k < len(outer) and outer[k][0] < p <= outer[k][1]:
            continue
        if not text[p:hi].strip():
            return
        before, script = text[max(lo, p - CONTEXT) : p], _script_at(text, p, lo)
        if not marked and script != "thai" and not _HAS_THAI.match(text, p - 1):
            if not (_HAS_THAI.search(before) and text[p - 1] in "”\"’)0123456789"):
                continue
        if script in ("devanagari", "bengali") and (p - 1) in closes and closes[p - 1] == start and text[p - 1] in "”’\"" and _REPORTED.match(text, p):
            continue  # the quotation opens the sentence, and its report follows
        rules, rest, gate = cascade(script, language)
        asked = gate.search(before)
        if asked and script == "latin":
            rules = cascade(script, language or language_of(text[start : min(hi, p + AHEAD)]))[0]
        for is_break, b, a in rules if asked else rest:
            if (b is None or b.search(before)) and a.match(text, p, hi):
                if is_break:
                    yield p
                    while p < hi and text[p].isspace():
                        p += 1
                    start = p
                break


def sentences(text: str | None, language: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in order, white space around it left out; null and blank texts have none."""
    if not text:
        return []
    if not text.isascii() and _OTHER_FORMS.search(text):
        text = text.translate(_SAME)
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if piece:
            out.append((a + lead, a + lead + len(piece)))

    lo = 0
    for hi in [*(m.start() for m in _PARAGRAPH.finditer(text)), len(text)]:
        while lo < hi and text[lo].isspace():
            lo += 1
        if lo < hi:
            at = lo
            for p in _breaks(text, lo, hi, language):
                add(at, p)
                at = p
            add(at, hi)
        lo = hi
    return out


def split_sentences(texts: DataFrame, id_col: str = "result_id", text_col: str = "text") -> DataFrame:
    """One row for each sentence of each row: {id_col}, start_char, end_char (BIGINT offsets).

    Narrow: no shuffle, one Arrow pass over two columns. Null, empty and blank texts give no row;
    rows repeated in the input are repeated in the result. Other columns are left out, so their names can't clash.
    """
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for a, b in sentences(t):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=[id_col, "start_char", "end_char"],
            )

    picked = texts.select(F.col(id_col), F.col(text_col))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, start_char bigint, end_char bigint")
