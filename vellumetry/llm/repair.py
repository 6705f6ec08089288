"""Repair of text recognised from scanned pages (problem 5).

Method. Words are counted over all pages; those that recur on pages put right by hand are the
vocabulary. A word unknown there is looked up in tries of the vocabulary, intersected with the
automaton of all words within one edit of it, so that no candidate is missed; pairs of letters that
print alike ("rn" and "m") count as one edit. One edit leaves one half of a word as it is, so the
vocabulary is sharded by halves and a word only goes where its halves are. Candidates are ranked by
how often they occur, by how often their letters are misread that way, and by their neighbours on
corrected pages; a result the recogniser was unsure of needs less of a lead. Runs of kanji, katakana
and Thai are looked up too, by look-alike characters only.

Running titles are found by the titles their volume has in its header regions, or else by its name,
page numbers and sheet marks by their form and place. Words broken at line ends are joined unless the
hyphenated form is a compound in use; where the hyphen is lost, if the whole is a word and a part is
none. Text is then reflowed into paragraphs.

Names are never corrected: a word with a capital counts as a name unless a word of the vocabulary
that is no name is one edit away; in scripts without capitals, names are told by endings that very
many different words share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.canonical import tidied
from vellumetry.session import stored

# Strings that are misread for each other, as printed -> as misread.
CONFUSED = (("m", "rn"), ("d", "cl"), ("w", "vv"), ("h", "li"), ("h", "lı"), ("u", "ii"), ("ü", "ii"), ("n", "ri"), ("k", "lc"), ("b", "lo"), ("m", "nn"), ("g", "cj"))
# Pairs of letters that are read as one.
CONTRACTED = (("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("nn", "m"), ("ii", "u"), ("vv", "w"))
# Characters of scripts without spaces that look alike.
ALIKE = ("ソン", "シツ", "ロ口", "カ力", "ニ二", "ハ八", "エ工", "タ夕", "ト卜", "ー一", "未末", "土士", "日曰", "千干", "人入", "大太犬", "石右", "自白", "目日", "ดคต", "ถภ", "ผฝ", "พฟ", "ซช", "ขช", "บป", "ฎฏ", "นม")
# Hyphens that layouts break words with.
BREAK = "-‐‑=¬­"
#: Share of the corrected words of the script that makes a word without capitals ordinary, another one, and one with an ending of names.
ORDINARY, ORDINARY_CAPITAL, ORDINARY_NAMELIKE = 5e-6, 6e-5, 9e-4
#: Share of a script's different words from which on an ending, its last two code points, is one that names are formed with.
NAME_ENDING = 0.06
#: Least times on corrected pages, for words and for runs of scripts without spaces.
LEAST, LEAST_UNSPACED = 2, 8
#: How much rarer than its candidate a misread form is; where the recogniser was less sure than SURE, the second.
RARER, RARER_UNSURE, SURE = 4, 3, 0.9
#: Code points of a run of Thai that count as a word.
RUN = 6
#: Rows of words or vocabulary in a shard, and most words broadcast to skip known ones early.
SHARD, KNOWN = 20_000, 100_000
#: Entries of a task's word counts before they are handed on.
FLUSH = 200_000

_TOKEN = re.compile(r"[^\s“”„«»‘’'\"()\[\]{}…,;:?¿¡—–।॥、。　-鿿가-퟿฀-๿]+")
_ENDS = re.compile(r"^[.\-*·~^#%&/\\+]+|[.!\-|*·~^#%&/\\+]+$")
_JOINT = re.compile(r"(?<=[a-zß-öø-ÿ])\.(?=[A-ZÀ-ÖØ-Þ])")
_PAGE = re.compile(r"[\[(—–\-\s.·*|]*[\dlIOoSBZ|]{0,4}\d[\dlIOoSBZ|]{0,3}[\])—–\-\s.·*|]*|[\[(—–\-]\s*[lIOo\d]{1,3}\s*[\])—–\-]|[lIO]{2,3}")
_SHEET = re.compile(r"[A-Z]{1,2}\s?[\dlIOo]{1,2}\s?[*.]?")
_ROMAN = re.compile(r"[\W_]*(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})[\W_]*", re.IGNORECASE)
_NUMBER_AT_END = re.compile(r"^[\[(—–\-\s.·|]*[\dlIOoSBZ]{1,4}[\])—–\-.·|]*\s+|[\s.·|—–\-\[(]+[\dlIOoSBZ]{1,4}[\])—–\-\s.·|]*$")
_DIGIT_LETTERS = str.maketrans("0158|@", "oissia")


_IDEOGRAPHIC = re.compile("[一-鿿々ァ-ヺー]{2,}")
_THAI = re.compile("[฀-๿]+")
_SPACELESS = re.compile("[一-鿿々ァ-ヺー฀-๿]")


#: Chunks of text between spaces and marks that a worker keeps with the words in them.
MEMO = 300_000
_chunks: dict[str, tuple[tuple[str, int, str, bool], ...]] = {}


def _words_in(chunk: str) -> tuple[tuple[str, int, str, bool], ...]:
    """(word, offset, form it is counted under, without a capital) of the words of a chunk."""
    out, at = [], 0
    for part in _JOINT.split(chunk):
        lead = _ENDS.match(part)
        a = lead.end() if lead and lead.start() == 0 else 0
        word = _ENDS.sub("", part[a:])
        if any(map(str.isalpha, word)):
            low = plain_word(word)
            out.append((word, at + a, low, word[0] == low[:1]))
        at += len(part) + 1
    got = tuple(out)
    if len(_chunks) < MEMO:
        _chunks[chunk] = got
    return got


def token_words(line: str) -> Iterator[tuple[str, int, str, bool]]:
    """The words of a line with their offsets in it; symbols inside a word stay in it, as they may stand for a letter."""
    if not line.isascii() and _SPACELESS.search(line):
        for m in _IDEOGRAPHIC.finditer(line):
            yield m.group(), m.start(), m.group(), True
        for m in _THAI.finditer(line):
            run = m.group()
            for i in range(len(run) - RUN + 1):
                yield run[i : i + RUN], m.start() + i, run[i : i + RUN], True
    for m in _TOKEN.finditer(line):
        chunk = m.group()
        got = _chunks.get(chunk)
        if got is None:
            got = _words_in(chunk)
        at = m.start()
        for word, off, low, small in got:
            yield word, at + off, low, small


def plain_word(word: str) -> str:
    """The form words are counted under: lower case, and without joiners, which are no misreading."""
    return word.lower().replace("\u200c", "").replace("\u200d", "")


def _title_key(line: str) -> str:
    line = _NUMBER_AT_END.sub("", line.strip())
    return "".join(c for c in line.translate(_DIGIT_LETTERS).casefold() if c.isalpha() or "ऀ" <= c <= "๿")


def _alike(a: str, b: str) -> bool:
    """Equal but for about one character in six, by pairs of neighbours."""
    if not a or not b or abs(len(a) - len(b)) > max(1, len(b) // 6):
        return False
    if a == b:
        return True
    x, y = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return len(x & y) >= 0.66 * max(len(x), len(y), 1)


def _pieces(title: str) -> list[str]:
    """Parts of a title, one of which a line must have to be it: its longer words, or runs of letters where it has none."""
    plain = title.casefold()
    words = [w for w in re.findall(r"[^\W\d_]{4,}", plain)]
    return words if len(words) > 1 else [plain[i : i + 3] for i in range(0, max(1, len(plain) - 2), 2)]


def _numbered(x: str, n: int, lines: list[str]) -> bool:
    """Is a line a page number or sheet mark? A roman number is small, and has marks around it or opens or ends the page; as a paragraph by itself inside the page it is a heading."""
    if _PAGE.fullmatch(x) or _SHEET.fullmatch(x):
        return any(map(str.isdigit, x)) or len(x) > 1
    if not _ROMAN.fullmatch(x) or x != x.lower():
        return False
    edge = n == 0 or n == len(lines) - 1
    alone = not edge and not lines[n - 1].strip() and not lines[n + 1].strip()
    return edge or not x.isalpha() and not alone


def furniture(lines: list[str], title: str | None) -> list[bool]:
    """Which lines are running titles (title: those of the volume, a line each), page numbers (roman ones too) or sheet marks. Ornaments and headings aren't."""
    wanted = [(t, k, len(t) * 3 // 4, len(t) + 24, _pieces(t)) for t in (title or "").split("\n") if (k := _title_key(t))]
    out = []
    for n, line in enumerate(lines):
        x = line.strip()
        found = bool(x) and len(x) <= 12 and _numbered(x, n, lines)
        if x and not found and wanted:
            plain = ""
            for _, key, least, most, pieces in wanted:
                if least <= len(x) <= most:
                    plain = plain or x.casefold()
                    if any(w in plain for w in pieces) and _alike(_title_key(x), key):
                        found = True
                        break
        out.append(found)
    return out


_WORD_PART = r"[^\s“”„«»‘’'\"()\[\]{}…,;:?!¿¡—–।॥、。]"
_INSIDE = re.compile(rf"({_WORD_PART}*[^\W\d_])[{BREAK}][^\S\n]+(?=[^\W\d_])((?:(?!\.){_WORD_PART})+)")
_AT_END = re.compile(rf"({_WORD_PART}*[^\W\d_])[{BREAK}]\s*$")
_MAY_BREAK = re.compile(rf"[{BREAK}](?=\s|$)")
_SECOND = re.compile(rf"(?:(?!\.){_WORD_PART})+")
# Words after a hyphen that is left hanging on purpose ("Ein- und Ausgang").
HANGING = ("und", "oder", "et", "y", "and", "or")


def broken_words(lines: list[str], skip: list[bool]) -> list[tuple[int, int, str, str, int]]:
    """(line, offset, first part, second part, line of the second part) of each word a hyphen and a break divide."""
    out = []
    for n, line in enumerate(lines):
        if skip[n] or not _MAY_BREAK.search(line):
            continue
        for m in _INSIDE.finditer(line):
            if m.group(2)[0].islower() and m.group(2) not in HANGING:
                out.append((n, m.start(1), m.group(1), m.group(2), n))
        if end := _AT_END.search(line):
            for k in range(n + 1, len(lines)):
                nxt = lines[k].strip()
                if skip[k] or not nxt or not nxt[0].islower():
                    continue  # a title, a notice or a blank line between the two halves
                if second := _SECOND.match(nxt):
                    out.append((n, end.start(1), end.group(1), second.group(), k))
                break
    return out


_LETTERS = re.compile(r"(?:[^\W\d_\u0e00-\u0e7f\u3000-\u9fff]|[ऀ-ःऺ-ॏঁ-ঃ়-্])+")
_SOFT_AT_END = re.compile("\u00ad(?=\\s|$)")


class Text:
    """A text's lines, tidied, with the marks of layout found; words broken in two are joined."""

    def __init__(self, text: str, title: str | None):
        if "\u00ad" in text:  # soft hyphens that end a line are layout; tidied() would drop them
            text = _SOFT_AT_END.sub("¬", text)
        self.lines = tidied(text).split("\n")
        self.furniture = furniture(self.lines, tidied(title) if title else None)
        self.broken = broken_words(self.lines, self.furniture)
        self._tokens: list[list[tuple[str, int, str, bool]] | None] = [None] * len(self.lines)

    def tokens(self, n: int) -> list[tuple[str, int, str, bool]]:
        if self._tokens[n] is None:
            self._tokens[n] = list(token_words(self.lines[n]))
        return self._tokens[n]

    def words(self) -> list[tuple[str, bool, int, int, int]]:
        """(form counted under, without a capital, line, line of its second part, length of its first part) of all words, each broken one once."""
        out: list[tuple[str, bool, int, int, int]] = []
        parts = {(n, at): (a, b, k) for n, at, a, b, k in self.broken}
        taken = Counter((k, b) for _, _, _, b, k in self.broken)
        lines = {n for n, _ in parts} | {k for k, _ in taken}
        for n, skip in enumerate(self.furniture):
            if skip:
                continue
            if n not in lines:
                out += [(low, small, n, n, len(low)) for _, _, low, small in self.tokens(n)]
                continue
            for word, at, low, small in self.tokens(n):
                if (n, at) in parts:
                    a, b, k = parts[n, at]
                    out.append((plain_word(a + b), small, n, k, len(a)))
                elif taken.get((n, word)):
                    taken[n, word] -= 1
                else:
                    out.append((low, small, n, n, len(low)))
        return out

    def forms(self) -> list[tuple[str, bool]]:
        """(form counted under, without a capital) of all words; places aren't needed, so lines without a broken word are taken chunk by chunk."""
        if self.broken:
            return [(low, small) for low, small, *_ in self.words()]
        out: list[tuple[str, bool]] = []
        for skip, line in zip(self.furniture, self.lines, strict=True):
            if skip:
                continue
            if not line.isascii() and _SPACELESS.search(line):
                out += [(low, small) for _, _, low, small in token_words(line)]
                continue
            for chunk in _TOKEN.findall(line):
                got = _chunks.get(chunk)
                for _, _, low, small in got if got is not None else _words_in(chunk):
                    out.append((low, small))
        return out

    def gaps(self, known: frozenset[str]) -> list[tuple[int, int, str, str]]:
        """(line, line of the second part, first part, second part) of neighbours that may be one word whose hyphen is lost: not both known, within a line neither."""
        out = []
        firsts, seconds = {(n, at) for n, at, *_ in self.broken}, {(k, b) for *_, b, k in self.broken}
        last: tuple[int, int, int, str, bool] | None = None  # line, place, end and form of the word before, and whether it is unknown
        for n, line in enumerate(self.lines):
            if self.furniture[n]:
                continue
            if not line.strip():
                last = None
                continue
            lead = len(line) - len(line.lstrip())
            for word, at, low, small in self.tokens(n):
                new = low not in known
                if last is not None and small and (new or last[4]) and _LETTERS.fullmatch(word) and _LETTERS.fullmatch(last[3]):
                    pn, place, end, first, _ = last
                    adjacent = at == lead and end == len(self.lines[pn].rstrip()) if pn < n else new and last[4] and line[end:at] == " "
                    if adjacent and (n, word) not in seconds and (pn, place) not in firsts:
                        out.append((pn, n, first, low))
                last = (n, at, at + len(word), low, new)
        return out

    def reflowed(self, right: dict[str, str], compounds: set[str], parts: list[tuple[str, str]] = []) -> str:
        """Paragraphs without furniture, broken words joined (compounds keep their hyphen; parts: those without one) and misread words put right."""

        def put_right(word: str) -> str:
            new = right.get(plain_word(word))
            if new is None:
                return word
            return new.upper() if word.isupper() and len(word) > 1 else new[:1].upper() + new[1:] if word[:1].isupper() else new

        lines: list[str | None] = [None if f else line for line, f in zip(self.lines, self.furniture, strict=True)]
        for n, at, a, b, k in reversed(self.broken):
            whole = f"{a}-{b}" if plain_word(f"{a}-{b}") in compounds else a + b
            if k == n:
                lines[n] = lines[n][:at] + re.sub(rf"^{re.escape(a)}[{BREAK}]\s+{re.escape(b)}", lambda m, w=whole: w, lines[n][at:])
            else:
                lines[k] = re.sub(rf"^\s*{re.escape(b)}", "", lines[k], count=1)
                lines[n] = lines[n][:at] + whole
                rest = re.match(r"[^\s]*", lines[k]).group()  # marks that follow the word
                lines[n] += rest
                lines[k] = lines[k][len(rest) :].lstrip()
                if not lines[k]:
                    lines[k] = None
        out: list[str] = []
        for line in lines:
            if line is None:
                continue
            if not line.strip():
                out.append("")
                continue
            for word, at, _, _ in sorted(token_words(line), key=lambda w: -w[1]) if right else ():
                if (new := put_right(word)) != word:
                    line = line[:at] + new + line[at + len(word) :]
            line = re.sub(r"\s+", " ", line.strip())
            if out and out[-1]:
                out[-1] += line if _UNSPACED.match(out[-1][-1]) and _UNSPACED.match(line[0]) else f" {line}"
            else:
                out.append(line)
        whole = "\n\n".join(p for p in out if p)
        for a, b in parts:
            whole = re.sub(rf"(?<!\w)({re.escape(a)}) ({re.escape(b)})(?!\w)", r"\1\2", whole, flags=re.IGNORECASE)
        return whole


_UNSPACED = re.compile("[\u3000-\u9fff\uff00-\uffef\u0e00-\u0e7f]")


def word_counts(texts: DataFrame, text_col: str, confirmed_col: str, title_col: str) -> DataFrame:
    """(word in lower case, n_right, n_raw, n_lower): occurrences on corrected pages, on others, and without a capital on corrected ones.

    Two words with a space between are neighbours; these are counted on corrected pages only.
    Counted in each task first and merged by one shuffle on the word, so frequent words aren't hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: Counter[tuple[str, bool]] = Counter()
        raw: Counter[tuple[str, bool]] = Counter()
        pairs: Counter[tuple[str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w, _ in right] + [w for w, _ in raw] + [f"{a} {b}" for a, b in pairs]
            n_right = [*right.values(), *[0] * len(raw), *pairs.values()]
            n_raw = [*[0] * len(right), *raw.values(), *[0] * len(pairs)]
            n_lower = [*(n if small else 0 for (_, small), n in right.items()), *[0] * (len(raw) + len(pairs))]
            for c in (right, raw, pairs):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array(c, pa.int64()) for c in (n_right, n_raw, n_lower))], names=["word", "n_right", "n_raw", "n_lower"])

        for batch in batches:
            for text, is_right, title in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = Text(text, title).forms()
                (right if is_right else raw).update(found)
                if is_right:
                    forms = [w for w, _ in found]
                    pairs.update(zip(forms, forms[1:], strict=False))
            if len(right) + len(raw) + len(pairs) > FLUSH:
                yield flush()
        yield flush()

    picked = texts.where(F.col(text_col).isNotNull()).select(text_col, F.coalesce(confirmed_col, F.lit(False)), title_col)
    counted = picked.mapInArrow(run, "word string, n_right bigint, n_raw bigint, n_lower bigint")
    return counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_right", "n_raw", "n_lower")))


class Trie:
    """A trie of words with their counts; near() is its intersection with an automaton of all words within one edit."""

    def __init__(self, words: dict[str, int]):
        self.words, self.root = words, {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = {}

    @staticmethod
    def _rest(node: dict, w: str, i: int) -> bool:
        for c in w[i:]:
            node = node.get(c)
            if node is None:
                return False
        return "" in node

    def near(self, w: str) -> set[str]:
        out: set[str] = set()
        node, n = self.root, len(w)
        for i in range(n + 1):
            if i < n and self._rest(node, w, i + 1):
                out.add(w[:i] + w[i + 1 :])
            for c, child in node.items():
                if c:
                    if i < n and c != w[i] and self._rest(child, w, i + 1):
                        out.add(w[:i] + c + w[i + 1 :])
                    if self._rest(child, w, i):
                        out.add(w[:i] + c + w[i:])
            if i == n:
                if "" in node:
                    out.add(w)
                break
            node = node.get(w[i])
            if node is None:
                break
        return out | self.confused(w)

    def confused(self, w: str) -> set[str]:
        """Words that w stands for if letters in it were read for others that print alike."""
        out = set()
        for printed, read in (*CONFUSED, *CONTRACTED):
            at = w.find(read)
            while at >= 0:
                v = w[:at] + printed + w[at + len(read) :]
                if v in self.words:
                    out.add(v)
                at = w.find(read, at + 1)
        return out

    def alike(self, w: str) -> set[str]:
        """Words with one character less or more of its look-alikes."""
        return {v for i, c in enumerate(w) for group in ALIKE if c in group for x in group if x != c and (v := w[:i] + x + w[i + 1 :]) in self.words}


_SYMBOL = re.compile(r"[^\W\d_][^\w\s'’.\-]+|^[^\w\s'’.\-]+[^\W\d_]|\d")


def candidates(word: str, trie: Trie) -> list[str]:
    """Words that word may be a misreading of. Words of three letters count if letters that print alike do, shorter ones if a sign or digit stands in them."""
    if _SPACELESS.match(word):
        return sorted(trie.alike(word))
    letters = sum(map(str.isalpha, word))
    odd = bool(_SYMBOL.search(word))
    if "." in word or letters < (1 if odd else 3) or letters * 2 < len(re.sub(r"[ऀ-৿]", "", word)):
        return []
    plain = word.replace("-", "")  # a hyphen lost or kept is no misreading
    found = trie.near(word) if odd or letters > 3 else trie.confused(word)
    return [c for c in found if c.replace("-", "") != plain and (len(c) >= 4 or odd and len(c) >= 2)]


def vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordinary words: word, n_right; words to look up: word, n_raw)."""
    script = F.when(F.col("word").rlike("[ऀ-ॿ]"), "deva").when(F.col("word").rlike("[ঀ-৿]"), "beng").when(F.col("word").rlike("^[一-鿿々ァ-ヺー\u0e00-\u0e7f]"), "none").otherwise("latin")
    right = counts.where("n_right > 0").select(script.alias("s"), F.when(script.isin("deva", "beng"), F.substring("word", -2, 2)).alias("e"), "n_right")
    # a row for each script and ending that very many words share
    endings = right.groupBy("s", "e").agg(F.count("*").alias("d"), F.sum("n_right").alias("n"))
    sums = {r["s"]: (r["d"], r["n"]) for r in endings.groupBy("s").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).collect()}
    of = lambda s, i: sums.get(s, (0, 0))[i]
    many = F.greatest(F.lit(20.0), NAME_ENDING * F.when(F.col("s") == "deva", float(of("deva", 0))).otherwise(float(of("beng", 0))))
    names = [r["e"] for r in endings.where(F.col("e").isNotNull() & (F.col("d") >= many)).select("e").collect()]  # at most 1 / NAME_ENDING a script
    at_least = lambda share, s: F.lit(max(float(LEAST), share * of(s, 1)))
    namelike = F.substring("word", -2, 2).isin(names) if names else F.lit(False)
    indic = lambda s: F.when(namelike, at_least(ORDINARY_NAMELIKE, s)).otherwise(at_least(ORDINARY, s))
    latin = F.when(F.col("n_lower") * 2 >= F.col("n_right"), at_least(ORDINARY, "latin")).otherwise(at_least(ORDINARY_CAPITAL, "latin"))
    least = F.when(script == "deva", indic("deva")).when(script == "beng", indic("beng")).when(script == "none", F.lit(float(LEAST_UNSPACED))).otherwise(latin)
    well_formed = ~F.col("word").rlike(r"[^\p{L}\p{M}'’\-ー]")
    ordinary = counts.where((F.col("n_right") >= least) & well_formed).select("word", "n_right")
    unknown = counts.where((F.col("n_right") == 0) & (F.col("n_raw") > 0)).select("word", "n_raw")
    return ordinary, unknown


def _folded(word: Column) -> Column:
    """Letters that are read for each other made one, so that two letters read as one leave the same."""
    for two, one in CONTRACTED:
        word = F.replace(word, F.lit(two), F.lit(one))
    return word


def _halves(word: Column, length: Column) -> list[Column]:
    """The first half of a word of this length, if word begins with it, and the second, if it ends with it; each with the length."""
    first, rest = F.floor(length / 2).cast("int"), length - F.floor(length / 2).cast("int")
    return [F.concat_ws("|", F.lit("p"), length, F.substr(word, F.lit(1), first)), F.concat_ws("|", F.lit("s"), length, F.substr(word, F.length(word) - rest + 1, rest))]


def _edit(printed: str, read: str) -> tuple[int, str]:
    """(where two words begin to differ, how: printed>read)."""
    a = next((i for i, (x, y) in enumerate(zip(printed, read, strict=False)) if x != y), min(len(printed), len(read)))
    b = 0
    while b < min(len(printed), len(read)) - a and printed[-1 - b] == read[-1 - b]:
        b += 1
    return a, f"{printed[a : len(printed) - b]}>{read[a : len(read) - b]}"


def corrections(ordinary: DataFrame, unknown: DataFrame) -> DataFrame:
    """(word, n_raw, right, n, at, edit): all candidates of each word, with where and how the two differ.

    One edit leaves a candidate's first or second half as it is, or both are the same once letters that
    are read as one are made one. These are the keys the vocabulary is sharded by, so each word is
    copied to as many shards as it has keys that the vocabulary has too, however large either is.
    """
    spark = ordinary.sparkSession
    n = F.length("word")
    known = ordinary.withColumn("key", F.explode(F.array(*_halves(F.col("word"), n), F.concat(F.lit("f|"), _folded(F.col("word"))))))
    asked = [k for d in (-1, 0, 1) for k in _halves(F.col("word"), n + d)]
    words = unknown.where(n > 1).withColumn("key", F.explode(F.array(*asked, F.concat(F.lit("f|"), _folded(F.col("word"))))))
    words = stored(words.join(known.select("key").distinct(), "key", "left_semi"), "p5-asked")
    known = stored(known.join(words.select("key").distinct(), "key", "left_semi"), "p5-known")
    shards = max(spark.sparkContext.defaultParallelism, -(-max(words.count(), known.count()) // SHARD))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    left = words.select("word", "n_raw", shard).distinct().repartition(shards, "shard")
    right = known.select("word", "n_right", shard).distinct().repartition(shards, "shard")

    def run(words: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(dict(zip(known["word"], known["n_right"], strict=True)))
        out = []
        for w, n in zip(words["word"], words["n_raw"], strict=True):
            for c in candidates(w, trie):
                if trie.words[c] >= RARER_UNSURE * n:
                    out.append((w, n, c, int(trie.words[c]), *_edit(c, w)))
        return pd.DataFrame(out, columns=["word", "n_raw", "right", "n", "at", "edit"])

    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(run, "word string, n_raw bigint, right string, n bigint, at int, edit string")
    return found.distinct()


def titles(results: DataFrame, regions: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """(volume_id, title): the texts found in a volume's header regions, a line each: the commonest, and those at least a quarter as common that recur.

    Volumes without such a text have their name in volumes, without its number, unless it is nothing but a number.
    """
    headers = regions.where(F.lower(F.trim("region_type")) == "header").select("region_id")
    texts = results.where("text is not null and trim(text) <> '' and volume_id is not null").join(headers.hint("shuffle_hash"), "region_id", "left_semi")
    tidy = F.trim(F.regexp_replace("text", r"[.\s]+$", ""))
    counted = texts.groupBy("volume_id", F.regexp_replace(tidy, r"\s+", " ").alias("title")).agg(F.count("*").alias("n"))
    top = counted.groupBy("volume_id").agg(F.max(F.struct("n", "title")).alias("top"))
    often = counted.join(top, "volume_id").where("title = top.title or n > 1 and 4 * n >= top.n")
    heads = often.groupBy("volume_id").agg(F.array_join(F.array_sort(F.collect_set("title")), "\n").alias("title"))
    if volumes is None:
        return heads
    name = F.trim(F.regexp_replace("volume_name", r",\s*no\.\s*\d+\s*$", ""))
    named = volumes.select("volume_id", name.alias("name")).where(F.length("name") > 0).where(~F.col("name").rlike(r"(?i)^volume\s*\d*$"))
    named = named.groupBy("volume_id").agg(F.max("name").alias("name"))
    return heads.join(named, "volume_id", "full").select("volume_id", F.coalesce("title", "name").alias("title"))


class _Found:
    """What damage() and repaired() share: counts of words, corrections, and the marks of each text, all stored."""

    def __init__(self, texts: DataFrame, id_col: str, text_col: str, confirmed_col: str, title_col: str, sure_col: str):
        sure = F.col(sure_col).cast("double") if sure_col in texts.columns else F.lit(None).cast("double")
        unsure = F.coalesce(F.when(sure > 1, sure / 100).otherwise(sure) < SURE, F.lit(True))
        # read twice: the joins that brought pages and titles to the texts run once
        texts = stored(texts.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.coalesce(confirmed_col, F.lit(False)).alias(confirmed_col), title_col, unsure.alias("_unsure")), "p5-texts")
        counts = stored(word_counts(texts, text_col, confirmed_col, title_col), "p5-counts")
        pair = F.col("word").contains(" ")
        pairs, counts = counts.where(pair), counts.where(~pair)
        ordinary, unknown = vocabulary(counts)
        ordinary, unknown = stored(ordinary, "p5-ordinary"), stored(unknown, "p5-unknown")
        fixes = stored(corrections(ordinary, unknown), "p5-fixes")
        # a bounded set of the commonest words of corrected pages; it only saves looking them up, as no fix or gap needs them
        top = [r["word"] for r in counts.where("n_right > 0").orderBy(F.desc(F.col("n_right") + F.col("n_raw")), "word").limit(KNOWN).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(frozenset(top))
        kind = dict(texts.dtypes)[id_col]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                rows: list[int] = []
                out: list[tuple] = []
                for r, (text, title) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    t = Text(text, title)
                    found = [(n, -1, 0, "furniture", None, None, None) for n, is_furniture in enumerate(t.furniture) if is_furniture]
                    found += [(n, n, 0, "hyphen", plain_word(a + b), plain_word(f"{a}-{b}"), None) for n, _, a, b, _ in t.broken]
                    found += [(n, k, 0, "gap", a + b, a, b) for n, k, a, b in t.gaps(known)]
                    listed = t.words()
                    for i, (low, _, n, k, cut) in enumerate(listed):
                        if low not in known:
                            found.append((n, k, cut, "misread", low, listed[i - 1][0] if i else None, listed[i + 1][0] if i + 1 < len(listed) else None))
                    rows += [r] * len(found)
                    out += found
                cols = list(zip(*out, strict=True)) or [()] * 7
                types = (pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), batch.column(3).take(at)],
                    names=[id_col, "line_no", "next_no", "cut", "kind", "word", "before", "after", "unsure"],
                )

        self.id = id_col
        self.raw = texts.where(~F.col(confirmed_col)).select(id_col, text_col, title_col, "_unsure")
        marks = self.raw.mapInArrow(run, f"`{id_col}` {kind}, line_no bigint, next_no bigint, cut bigint, kind string, word string, before string, after string, unsure boolean")
        self.marks = stored(marks, "p5-marks")
        # a compound keeps its hyphen where it is in use with it, and not less than without
        uses = F.col("n_right") + F.col("n_raw")
        used = counts.select(F.col("word").alias("before"), uses.alias("n_compound"))
        joined = counts.select("word", uses.alias("n_joined"))
        kept = (F.coalesce("n_compound", F.lit(0)) > 0) & (F.coalesce("n_joined", F.lit(0)) <= F.coalesce("n_compound", F.lit(0)))
        self.breaks = self.marks.where("kind = 'hyphen'").join(used, "before", "left").join(joined, "word", "left").withColumn("is_compound", kept)
        self.gaps = stored(self._gaps(counts), "p5-gaps")
        self.misread = stored(self._misread(pairs, fixes), "p5-misread")

    def _gaps(self, counts: DataFrame) -> DataFrame:
        """Words whose hyphen is lost: the whole is a word of corrected pages, or, of names, one in use; a part is no word there, of names and within a line both."""
        right = lambda name, n: counts.where("n_right > 0").select(F.col("word").alias(name), F.col("n_right").alias(n))
        whole = counts.select("word", "n_right", "n_lower", (F.col("n_right") + F.col("n_raw")).alias("n_all"))
        found = self.marks.where("kind = 'gap'").join(whole, "word")
        found = found.join(right("before", "n_a"), "before", "left").join(right("after", "n_b"), "after", "left")
        parts = F.when(F.col("n_a").isNull(), 1).otherwise(0) + F.when(F.col("n_b").isNull(), 1).otherwise(0)
        plain = (F.col("n_lower") > 0) & (F.col("n_right") >= LEAST)
        apart = F.when(F.col("line_no") == F.col("next_no"), 2).when(plain, 1).otherwise(2)
        return found.where((parts >= apart) & (plain | (F.col("n_all") > 0))).select(self.id, "line_no", "next_no", "word", "before", "after")

    def _misread(self, pairs: DataFrame, fixes: DataFrame) -> DataFrame:
        """(id, line_no, word, right): each misread word with the word it stands for, the same throughout a text."""
        parts = self.gaps.select(self.id, F.col("line_no"), F.col("before").alias("word")).unionByName(self.gaps.select(self.id, F.col("next_no").alias("line_no"), F.col("after").alias("word")))
        seen = self.marks.where("kind = 'misread'").join(fixes, "word").where(F.col("n") >= F.when(F.col("unsure"), RARER_UNSURE).otherwise(RARER) * F.col("n_raw"))
        seen = seen.join(parts.distinct(), [self.id, "line_no", "word"], "left_anti")
        line = F.when(F.col("at") < F.col("cut"), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no")
        seen = stored(seen.select(self.id, line, "word", "right", "n", "edit", "before", "after"), "p5-candidates")
        # how often letters are misread this way, by words with a single candidate; the same for all words
        single = fixes.groupBy("word").agg(F.count("*").alias("c"), F.max("edit").alias("edit"), F.max("n_raw").alias("n_raw")).where("c = 1")
        ways = single.groupBy("edit").agg(F.sum("n_raw").alias("ways"))
        several = fixes.groupBy("word").agg(F.count("*").alias("c")).where("c > 1").select("word")
        clear = seen.join(several, "word", "left_anti").select(self.id, "line_no", "word", "right")
        unclear = seen.join(several, "word", "left_semi")
        near = lambda name: pairs.select(F.col("word").alias(f"_{name}"), F.col("n_right").alias(name))
        met = unclear.withColumn("_l", F.concat_ws(" ", "before", "right")).withColumn("_r", F.concat_ws(" ", "right", "after")).join(near("l"), "_l", "left").join(near("r"), "_r", "left")
        seen_near = F.log1p(F.coalesce("l", F.lit(0))) + F.log1p(F.coalesce("r", F.lit(0)))
        by_text = met.groupBy(self.id, "word", "right", "edit").agg(F.max("n").alias("n"), F.sum(seen_near).alias("near"))
        score = F.log("n") + F.log1p(F.coalesce("ways", F.lit(0))) + 2 * F.col("near")
        best = by_text.join(ways, "edit", "left").groupBy(self.id, "word").agg(F.max_by("right", F.struct(score.alias("s"), "right")).alias("right"))
        return clear.unionByName(unclear.select(self.id, "line_no", "word", "right").join(best, [self.id, "word", "right"], "left_semi"))


def damage(
    texts: DataFrame, id_col: str = "result_id", text_col: str = "text", confirmed_col: str = "confirmed", title_col: str = "title", sure_col: str = "confidence"
) -> DataFrame:
    """({id_col}, line_no, kind, word, right): each mark of damage on pages that weren't put right by hand.

    kind is hyphen, misread or furniture; word and right are the misread form and the word it stands
    for, else null. Null and empty texts have none. Lines count from 0, blank ones too. A confidence is
    a share or a percentage; without one, texts count as unsure.
    """
    found = _Found(texts, id_col, text_col, confirmed_col, title_col, sure_col)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("word", "right")]
    plain = found.marks.where("kind = 'furniture'").select(id_col, "line_no", "kind", *nothing)
    hyphens = found.breaks.where("not is_compound").select(id_col, "line_no", "kind", *nothing)
    parts = found.gaps.select(id_col, "line_no", F.lit("hyphen").alias("kind"), *nothing)
    misread = found.misread.select(id_col, "line_no", F.lit("misread").alias("kind"), "word", "right")
    return plain.unionByName(hyphens).unionByName(parts).unionByName(misread)


def repaired(
    texts: DataFrame, id_col: str = "result_id", text_col: str = "text", confirmed_col: str = "confirmed", title_col: str = "title", sure_col: str = "confidence"
) -> DataFrame:
    """({id_col}, text) of pages that weren't put right by hand, as continuous paragraphs; empty texts stay empty, null ones give no row."""
    found = _Found(texts, id_col, text_col, confirmed_col, title_col, sure_col)
    # what is collected belongs to one text
    right = found.misread.groupBy(id_col).agg(F.collect_set(F.struct("word", "right")).alias("_right"))
    keep = found.breaks.where("is_compound").groupBy(id_col).agg(F.collect_set("before").alias("_keep"))
    parts = found.gaps.groupBy(id_col).agg(F.collect_set(F.struct("before", "after")).alias("_parts"))
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)
            out = [
                Text(t, title).reflowed({x["word"]: x["right"] for x in fixes or ()}, set(compounds or ()), [(x["before"], x["after"]) for x in apart or ()])
                for t, title, fixes, compounds, apart in rows
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    whole = found.raw.join(right, id_col, "left").join(keep, id_col, "left").join(parts, id_col, "left").select(id_col, text_col, title_col, "_right", "_keep", "_parts")
    return whole.mapInArrow(run, f"`{id_col}` {kind}, text string")
