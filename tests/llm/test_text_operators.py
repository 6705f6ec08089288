"""Text operators: known cases, brute force, round trips, and the edge cases each docstring defines."""

import os
import random
import time
import unicodedata as ud

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumetry.llm import bpe, canonical, language, leaks, repair, repeated_lines, sentences, subjects

TOKENIZERS = bpe.TOKENIZERS
DATA = "/root/testdata/sf0.01"


def texts(spark, rows, id_col="result_id"):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], f"{id_col} bigint, text string, doc string, start_char int")


def cut(text, lang=None):
    return [text[a:b] for a, b in sentences.sentences(text, lang)]


# ------------------------------------------------------------------ sentences


@pytest.mark.parametrize(
    "parts",
    [
        ["Mr. J. K. Tolby of Lan saw it, e.g. when it failed.", "At 4.30 p.m. the vicar left.", "It cost 3,811.5 crowns."],
        ["“Tell me,” said Miss Ab, “has it come yet?”", "Our clerk writes: “It is bad. It is worse.”", "(Nobody knew.)", "Have you seen it?!"],
        ["Im 3. Kapitel, S. 98, wird es z. B. genannt.", "„Wo ist er?“ fragte der Drucker.", "Am 12. Mai 1871 kam er."],
        ["« C’est rare ! » dit-il.", "Vers 5 h. 30 du soir, M. Dub vint, etc., sans mot dire.", "Quel objet !"],
        ["La Dra. Ab llegó a las 6 p. m.", "¿Dónde está?", "«Dígame —dijo él—, ¿dónde está el ancla?»"],
        ["क्या डॉ. दोका ने देखा?", "“कहाँ है?” यात्री ने पूछा।", "ई. 1816 में देखा |", "वाह, देखा!"],
        ["মো. গোলি নগরে রায় ক্রয় করিলেন।", "“আইন কোথায়?” বলিয়া পথিক গেলেন।"],
        ["Hoc modo, i. e. sine mora, emit.", "«Ubi est liber?» inquit magister."],
    ],
)
def test_known_sentences(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n".join(parts)) == parts


def test_scripts_without_spaces():
    assert cut("「古い鋤だ！」と彼は叫んだ。彼は「重い。無い。」と書いた。なんと重い鋤だろう！") == ["「古い鋤だ！」と彼は叫んだ。", "彼は「重い。無い。」と書いた。", "なんと重い鋤だろう！"]
    assert cut("เมื่อ พ.ศ. 1867 เขาซื้อเรือ ช่างซื้อไข้ ยาต้ม ฯลฯ จากเมืองบาง ชีพจรมีราคา 85.35 บาท") == ["เมื่อ พ.ศ. 1867 เขาซื้อเรือ", "ช่างซื้อไข้ ยาต้ม ฯลฯ จากเมืองบาง", "ชีพจรมีราคา 85.35 บาท"]


def test_blank_lines_break_and_missing_spaces_too():
    assert cut("One half\n\nof it. At 2.15 three") == ["One half", "of it.", "At 2.15 three"]
    assert cut("It was forgotten.At last he came") == ["It was forgotten.", "At last he came"]
    assert cut("a wrapped\nline. Next") == ["a wrapped\nline.", "Next"]


@pytest.mark.parametrize(
    "parts",
    [
        ["I said no.", "I left."],
        ["She said no.", "Can you help?"],
        ["See No. 12 or no. 3.", "It is in vol. IV and vol. xii of it."],
        ['It was 5" wide and 4" long.', "He left.", '"Who? Me?" she asked.'],
        ['A stray " stands here.', "It went.", "It came."],
        ["It was in Jan.", "I went on Jan. 5 of that year."],
    ],
)
def test_words_and_marks_that_mislead(parts):
    assert cut(" ".join(parts)) == parts


def test_language_of_a_sentence_chooses_its_table():
    assert sentences.language_of("the clerk of the town and") == "eng" and sentences.language_of("der Mann und die Frau") == "deu"
    assert sentences.language_of("the and of der die und") is None and sentences.language_of("Ab cd") is None
    # "Art." is an abbreviation before a number in English, "Z." in German only
    german, english = "Der Mann kam mit der Z. 7 und ging.", "The man of the house was at Z. 7 men left the house."
    assert cut(german) == [german] and cut(english) == ["The man of the house was at Z.", "7 men left the house."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?…“”«»()。」「\n।ก1’​", max_size=80))
def test_sentences_cover_all_but_spaces(text):
    spans = sentences.sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    covered = set(i for a, b in spans for i in range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_split_edge_cases(spark):
    long = "The end came. " * 20_000
    got = sentences.split_sentences(texts(spark, [None, "", "  \n ", "A b. C d.", long]))
    assert got.columns == ["result_id", "start_char", "end_char"]
    counts = {r.result_id: r["count"] for r in got.groupBy("result_id").count().collect()}
    assert counts == {3: 2, 4: 20_000}
    assert sentences.split_sentences(texts(spark, [])).count() == 0


# ------------------------------------------------------------------ canonical forms


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30))
def test_canonical_is_stable_and_composed(text):
    got = canonical.canonical(text)
    assert canonical.canonical(got) == got and ud.is_normalized("NFC", got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="eéœạ़́̈कো각가", max_size=16))
def test_segments_like_whole_text(text):
    assert canonical._nfc(text) == ud.normalize("NFC", text)


def test_look_alikes():
    same = ["naïve fine-ly", "naïve ﬁne‐ly", "ｎaïve fi​ne‑ly", "nаïvе fine­ly".replace("­ly", "-ly")]
    assert {canonical.canonical(t) for t in same} == {"naïve fine-ly"}
    assert canonical.canonical("क्‍ष") != canonical.canonical("क्ष")
    assert canonical.canonical("a‍b") == "ab"
    assert canonical.canonical("½ № ²") == "½ № ²"
    assert canonical.canonical("привет") == "привет"
    assert canonical.canonical(None) is None and canonical.canonical("") == ""


def test_texts_to_read_keep_their_own_letters():
    russian, persian = "хор оса сор", "می\u200cخواهم"
    assert canonical.canonical(russian) == "xop oca cop" and canonical.tidied(russian) == russian
    assert canonical.tidied(persian) == persian == canonical.canonical(persian)
    assert canonical.tidied("the nаme is сor") == "the name is cor" and canonical.tidied("слово cор") == "слово cop"
    assert canonical.tidied(None) is None and canonical.tidied("") == ""


def test_pairs_by_brute_force(spark):
    rng = random.Random(5)
    base = ["café noir", "the old fire", "ok", ""]
    forms = [lambda t: t, lambda t: ud.normalize("NFD", t), lambda t: t.replace(" ", " "), lambda t: t.replace("o", "о"), lambda t: t]
    rows = [rng.choice(forms)(rng.choice(base)) for _ in range(60)] + [None]
    expected = {(a, b) for a in range(60) for b in range(a + 1, 60) if rows[a] != rows[b] and canonical.canonical(rows[a]) == canonical.canonical(rows[b])}
    got = [tuple(r) for r in canonical.same_look_pairs(texts(spark, rows).unionByName(texts(spark, rows))).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert canonical.same_look_pairs(texts(spark, [])).count() == 0


# ------------------------------------------------------------------ repeated lines


def lines_case(spark):
    notice = "All rights in this image are reserved."
    rows = []
    for v in range(12):
        body = f"Line number {'abcdefghijkl'[v] * 13} alone\n"
        form = [notice, notice.upper(), notice.replace("a", "а"), "  " + notice + " 12"][v % 4]
        rows.append((v, f"{body}{form}\nshort line" if v < 5 else body, "s", f"v{v}", "k"))
    rows += [(100, None, "s", "v0", "k"), (101, "", "s", "v1", "k"), (102, notice, None, "v1", "k"), (103, notice, "t", "w0", "k")]
    return spark.createDataFrame(rows, "result_id bigint, text string, site_id string, volume_id string, item string")


def test_repeated_lines(spark):
    rows = lines_case(spark)
    volumes = spark.createDataFrame([("s", f"v{v}") for v in range(20)] + [("t", "w0")], "site_id string, volume_id string")
    found = {tuple(r) for r in repeated_lines.repeated_lines(rows, volumes).collect()}
    assert found == {(v, 1) for v in range(5)}
    more = volumes.unionByName(spark.createDataFrame([("s", f"u{v}") for v in range(6)], volumes.schema))
    assert repeated_lines.repeated_lines(rows, more).count() == 0  # 5 of 26 volumes are less than a fifth
    clean = repeated_lines.without_lines(rows, spark.createDataFrame([(0, 1)], "result_id bigint, line_no bigint"))
    assert {r.result_id: r.text for r in clean.collect()}[0].count("\n") == 1 and clean.count() == rows.count()
    assert repeated_lines.repeated_lines(rows.limit(0), volumes).count() == 0


def sequences_of(spark, docs, least):
    """(doc, from, to, items, support) of the operator's occurrences; docs: (doc, unit, items)."""
    items = spark.createDataFrame([(d, "s", u, n, x) for d, u, seq in docs for n, x in enumerate(seq)], "doc bigint, source string, unit string, line_no bigint, item string")
    items = items.withColumn("item", F.struct(F.xxhash64("item").alias("x"), F.xxhash64(F.lit(2), "item").alias("y")))
    thresholds = spark.createDataFrame([("s", float(least))], "source string, least double")
    singles, base = repeated_lines.frequent_lines(items, thresholds)
    rows = repeated_lines.frequent_sequences(items, singles, base, thresholds).collect()
    of = {d: seq for d, _, seq in docs}
    assert len({(r.pattern, tuple(of[r.doc][r.from_line : r.to_line + 1])) for r in rows}) == len({r.pattern for r in rows})
    return {(r.doc, r.from_line, r.to_line, tuple(of[r.doc][r.from_line : r.to_line + 1]), r.support) for r in rows if r.length == r.to_line - r.from_line + 1}


def sequences_by_brute_force(docs, least):
    units = {}
    for _, u, seq in docs:
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                units.setdefault(tuple(seq[a:b]), set()).add(u)
    out = set()
    for d, _, seq in docs:
        reach = 0
        for a in range(len(seq)):
            b = max((b for b in range(a + 1, len(seq) + 1) if len(units[tuple(seq[a:b])]) >= least), default=0)
            if b > reach:
                out.add((d, a, b - 1, tuple(seq[a:b]), len(units[tuple(seq[a:b])])))
                reach = b
    return out


def test_sequences_like_brute_force(spark):
    rng = random.Random(2)
    block = list("abcdefghijk")
    docs = [(d, f"u{d % 6}", [rng.choice("abcd") for _ in range(rng.randint(0, 5))] + (block[rng.randint(0, 2) :] if d % 3 else [])) for d in range(30)]
    assert sequences_of(spark, docs, 4) == sequences_by_brute_force(docs, 4)
    assert sequences_of(spark, [(d, u, []) for d, u, _ in docs] + [(99, "u", ["a"])], 4) == set()


def test_long_notices_end_soon(spark):
    notice = [f"notice line {chr(97 + i // 10)}{i % 10}" for i in range(40)]
    docs = [(d, f"u{d % 50}", [f"own {d}", *notice]) for d in range(1000)]
    began = time.time()
    got = sequences_of(spark, docs, 10)
    assert got == {(d, 1, 40, tuple(notice), 50) for d in range(1000)}
    assert time.time() - began < 60


def test_repeated_sequences(spark):
    volumes = spark.createDataFrame([("s", f"v{v}") for v in range(20)], "site_id string, volume_id string")
    pair = "This is the first notice line\n\nThis is the second notice line"
    rows = [(v, f"{pair}\nAn own line {'abcde'[v] * 9}" if v < 4 else "This is the second notice line", "s", f"v{v}") for v in range(5)] + [(9, None, "s", "v9")]
    data = spark.createDataFrame(rows, "result_id bigint, text string, site_id string, volume_id string")
    got = {(r.result_id, r.from_line, r.to_line, r.n_lines, r.support) for r in repeated_lines.repeated_sequences(data, volumes).collect()}
    assert got == {(v, 0, 2, 2, 4) for v in range(4)} | {(4, 0, 0, 1, 5)}
    assert repeated_lines.repeated_sequences(data.limit(0), volumes).count() == 0


# ------------------------------------------------------------------ languages


@pytest.fixture(scope="module")
def model():
    words = {"eng": "the and with was from which had this", "fra": "le la et dans avec une pour était", "deu": "der die und nicht mit wurde von ein"}
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(words[l].split()) for _ in range(9)) + ".", l) for _ in range(150) for l in words]
    rows += [("यह एक पुराना मकान है।", "hin"), ("彼は古い家を見た。", "jpn")] * 20
    wrong = [(t, "fra") for t, l in rows[:9] if l != "fra"]
    return language.fit(*map(list, zip(*rows, *wrong, strict=True)))


def test_stretches(model):
    text = "The clerk was with this. And the man had this. 彼は古い家を見た。Der Mann wurde von der Frau und nicht mit ein."
    got = language.detect(model, [text, "", None, "12 345"])
    assert [g[0] for g in got[0]] == ["eng", "jpn", "deu"] and got[1:] == [[], [], []]
    assert all(0 < g[1] <= 1 for g in got[0]) and got[0][0][2] == 0
    assert sum(language.detect(model, ["le clerc et la femme dans une maison avec"])[0][0][0] == "fra" for _ in range(1)) == 1


def test_labels_and_identify(spark, model):
    rows = spark.createDataFrame([(1, "the man was with this", "EN-GB", 1), (2, None, "und", 1), (3, "", " ", 1), (4, "le et la dans une", "eng+hin", 1)], "result_id bigint, text string, label string, lang int")
    named = {r.result_id: r.l for r in rows.select("result_id", language.labels_of(rows.label).alias("l")).collect()}
    assert named == {1: ["eng"], 2: [], 3: [], 4: ["eng", "hin"]}
    got = {r.result_id: (r.lang, r.n_segs) for r in language.identify(rows, model, "result_id", "text", "label").collect()}
    assert got == {1: ("eng", 1), 2: (None, 0), 3: (None, 0), 4: ("fra", 1)}
    assert language.train(rows.limit(0), label_col="label").temperature > 0


# ------------------------------------------------------------------ repair


def test_candidates_are_complete():
    vocabulary = {w: 10 for w in ["heavy", "secretary", "lamp", "had", "described", "above", "able", "cable", "table"]}
    trie = repair.Trie(vocabulary)

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        return any(a[:i] + b[i : i + 1] + a[i + 1 :] == b or a[:i] + b[i : i + 1] + a[i:] == b or a[:i] + a[i + 1 :] == b for i in range(len(a) + 1)) or a == b

    rng = random.Random(4)
    for w in list(vocabulary) + ["".join(rng.choice("abelhvyt") for _ in range(5)) for _ in range(300)]:
        expected = {v for v in vocabulary if one_edit(w, v)}
        confused = {w.replace(r, p, 1) for p, r in repair.CONFUSED} & set(vocabulary)
        assert expected <= trie.near(w) and trie.near(w) - expected <= set(vocabulary) and confused <= trie.near(w)
    assert repair.candidates("he@vy", trie) == ["heavy"] and "described" in repair.candidates("clescribed", trie)
    assert repair.candidates("larnp", trie) == ["lamp"] and repair.candidates("hab", trie) == []


def test_furniture_and_broken_words():
    lines = ["THE M0DEST JOURNAL OF ARDBY l63", "— 39 —", "[ 12 ]", "B 3", "CHAPTER THE SECOND.", "* * *", "a common line of text here", "1,234.5 crowns", "", "xxiv.", "civil", "ill"]
    assert repair.furniture(lines, "THE MODEST JOURNAL OF ARDBY") == [True, True, True, True, False, False, False, False, False, True, False, False]
    assert repair.furniture(["I", "", "IV.", "", "vi", "text", "[ xi ]", "xii"], None) == [False, False, False, False, False, False, True, True]
    assert repair.furniture(["a", "", "iv.", "", "b"], None) == [False] * 5  # a chapter's number
    assert repair.furniture(["12 LEFT TITLE OF IT", "RIGHT TITLE OF THIS 13"], "LEFT TITLE OF IT\nRIGHT TITLE OF THIS") == [True, True]
    t = repair.Text("It was recom-\n12\nmended by a well-\nbuilt man of Orn­\nby. Rechen- server", "T")
    assert [(n, a + b) for n, _, a, b, _ in t.broken] == [(0, "recommended"), (2, "wellbuilt"), (3, "Ornby"), (4, "Rechenserver")]


def test_damage(spark):
    right = ["the clerk described a well-built lamp and the heavy table"] * 30
    rows = [(i, t, True, "T", 0.9) for i, t in enumerate(right)]
    rows += [(100, "the clcrk de-\nscribed a well-\nbuilt 1amp\n\n[ 7 ]", False, "T", 0.5), (101, None, False, None, None), (102, "", False, None, None), (103, "the clcrk came to Heavyby", None, None, None)]
    data = spark.createDataFrame(rows, "result_id bigint, text string, confirmed boolean, title string, word double")
    got = {(r.result_id, r.line_no, r.kind) for r in repair.damage(data).collect()}
    assert got == {(100, 0, "misread"), (100, 0, "hyphen"), (100, 2, "misread"), (100, 4, "furniture"), (103, 0, "misread")}
    assert repair.damage(data.limit(0)).count() == 0
    text = {r.result_id: r.text for r in repair.repaired(data).collect()}
    assert text == {100: "the clerk described a well-built lamp", 102: "", 103: "the clerk came to Heavyby"}


def test_lost_hyphens_compounds_and_neighbours(spark):
    right = ["the clerk sold the second-rate post here", "a loft above the committee room", "the post of the clerk", "a loft above us"] * 12
    rows = [(i, t, True, "T", 0.99) for i, t in enumerate(right)]
    rows += [
        (100, "the com\nmittee sold the second-\nrate post", False, "T", 99.0),  # the hyphen is lost; a compound's isn't
        (101, "a commit tee of it", False, "T", 0.5),
        (102, "sold the fecond-rate poft here", False, "T", 0.5),  # s is read as f
        (103, "a loft above a poft above us", False, "T", 0.5),
    ]
    data = spark.createDataFrame(rows, "result_id bigint, text string, confirmed boolean, title string, confidence double")
    got = {(r.result_id, r.line_no, r.kind, r.word, r.right) for r in repair.damage(data).collect()}
    assert {g[:3] for g in got if g[0] < 102} == {(100, 0, "hyphen"), (101, 0, "hyphen")}
    assert (102, 0, "misread", "poft", "post") in got
    text = {r.result_id: r.text for r in repair.repaired(data).collect()}
    assert text[100] == "the committee sold the second-rate post" and text[101] == "a committee of it"
    assert text[102] == "sold the second-rate post here" and text[103] == "a loft above a loft above us"


def test_scripts_without_spaces_and_endings_of_names(spark):
    place = [f"{a}{b}গঞ্জ" for a in ("দোমা", "হাদি", "শিদি", "কাকা", "তাতি") for b in ("রা", "লি", "বা", "সু", "মো")]
    right = [f"{p} নগরে বিচারক দেখিলেন" for p in place] + ["彼はコンパイラを見た"] * 20 + ["โรงพยาบาลนี้"] * 20
    rows = [(i, t, True, None, 0.99) for i, t in enumerate(right)]
    rows += [(100, "বিচারক রিচারক", False, None, 0.9), (101, place[0].replace("দো", "গো"), False, None, 0.9), (102, "彼はコソパイラを見た", False, None, 0.9), (103, "โรงฟยาบาลนี้", False, None, 0.9)]
    data = spark.createDataFrame(rows, "result_id bigint, text string, confirmed boolean, title string, confidence double")
    assert {(r.result_id, r.kind) for r in repair.damage(data).collect()} == {(100, "misread"), (102, "misread"), (103, "misread")}
    text = {r.result_id: r.text for r in repair.repaired(data).collect()}
    assert text[100] == "বিচারক বিচারক" and text[102] == "彼はコンパイラを見た" and text[103] == "โรงพยาบาลนี้"


def test_halves_find_every_candidate(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abclmnr") for _ in range(rng.randint(4, 7))) for _ in range(300)})
    asked = sorted({"".join(rng.choice("abclmnr") for _ in range(rng.randint(4, 7))) for _ in range(200)} - set(words))
    known = spark.createDataFrame([(w, 100) for w in words], "word string, n_right bigint")
    got = {(r.word, r.right) for r in repair.corrections(known, spark.createDataFrame([(w, 1) for w in asked], "word string, n_raw bigint")).collect()}
    trie = repair.Trie(dict.fromkeys(words, 100))
    assert got == {(w, c) for w in asked for c in repair.candidates(w, trie)}


def test_titles_of_volumes_without_headers(spark):
    results = spark.createDataFrame([("a", "r", "THE OWN TITLE."), ("b", "gone", "x")], "volume_id string, region_id string, text string")
    regions = spark.createDataFrame([("r", " Header")], "region_id string, region_type string")
    names = [("a", "Another Name, no. 2"), ("b", "The Modest Journal Of Ardby, no. 12"), ("c", "Volume 14"), ("d", None), ("e", "東浜野雑誌")]
    volumes = spark.createDataFrame(names, "volume_id string, volume_name string")
    got = {r.volume_id: r.title for r in repair.titles(results, regions, volumes).collect()}
    assert got == {"a": "THE OWN TITLE", "b": "The Modest Journal Of Ardby", "e": "東浜野雑誌"}
    assert repair.furniture(["261 THE M0DEST JOURNAL OF ARDBY"], got["b"]) == [True]


def test_reflow_of_scripts_and_paragraphs():
    t = repair.Text("検査官は\n鋤を見た。\n12\nThe Clcrk  came,\nat last.\n\nNew (recom-\nmended), yes", "T")
    assert t.reflowed({"clcrk": "clerk"}, set()) == "検査官は鋤を見た。 The Clerk came, at last.\n\nNew (recommended), yes"


# ------------------------------------------------------------------ tokens


@pytest.fixture(scope="module")
def vocabulary():
    path = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    with open(path, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def reference(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_tokens_like_a_public_encoder(vocabulary, reference, text):
    assert vocabulary.encode(text) == reference.encode_ordinary(text)


def test_tokens_of_long_and_odd_texts(vocabulary, reference):
    for text in ["a" * 5000, "-" * 3000 + "x", "日本語の辞書" * 300, " \t\n  x", "<|endoftext|>", "I'll've 's"]:
        assert vocabulary.encode(text) == reference.encode_ordinary(text)
    assert vocabulary.encode(None) == [] and vocabulary.encode("") == []


def test_appends_and_edits_are_exact(vocabulary):
    rng = random.Random(8)
    e = bpe.Encoded(vocabulary, "Once upon a time,  there was")
    for _ in range(300):
        a = rng.randint(0, len(e.text))
        e.edit(a, min(len(e.text), a + rng.randint(0, 5)), "".join(rng.choice("ab '’slt  \n1日é") for _ in range(rng.randint(0, 6))))
        assert e.ids() == vocabulary.encode(e.text)
    long = bpe.Encoded(vocabulary, "some words here " * 400)
    assert long.edit(3000, 3001, "Q") < 12
    long.append(" more")
    assert long.ids() == vocabulary.encode(long.text)


def test_encode_rows(spark, vocabulary):
    got = {r.doc_id: r.ids for r in bpe.encode(texts(spark, [None, "", "Hello world"], "doc_id")).collect()}
    assert got == {0: [], 1: [], 2: vocabulary.encode("Hello world")}
    assert bpe.encode(texts(spark, [], "doc_id")).count() == 0


# ------------------------------------------------------------------ leaks


def test_tiles_are_greedy_and_apart():
    p = "a b c d e f g h i j k l m".split()
    t = "x h i j k l m y a b c d e f g z a b".split()
    got = leaks.tiles(p, t, 3)
    assert sorted(got) == [(0, 8, 7), (7, 1, 6)]
    assert leaks.tiles(p, [], 3) == [] and leaks.tiles([], t, 3) == [] and leaks.tiles(p, p, 3) == [(0, 0, 13)]


def test_seeds_are_shared_by_every_long_match():
    rng = random.Random(6)
    for _ in range(200):
        shared = [str(rng.randint(0, 400)) for _ in range(leaks.MIN_WORDS)]
        a, b = ([str(rng.randint(500, 900)) for _ in range(rng.randint(0, 20))] for _ in range(2))
        x, y = (set(leaks.seeds(leaks.numbers([*s, *shared, *s[::-1]])).tolist()) for s in (a, b))
        assert x & y


def test_leaks_by_brute_force(spark):
    item = "Neither Corby nor the clerk of Lanby saw the well-built lamp before Ostby himself had bought it for them all."
    words = item.split()
    docs = [
        "Once. " + " ".join(words[2:16]).upper() + " And more.",
        "Some words: " + " ".join(words[:11]),
        "It was said: nei-\nther Corby nor the cle­\nrk of Lаnby  saw, the well-\nbuilt lamp before Ostby himself",
        None, "", "short", item + " " + item,
        " ".join(words[12:] + words[:12]),
    ]
    corpus = texts(spark, docs, "doc_id")
    items = spark.createDataFrame([(7, item, "e"), (8, None, "e"), (9, "too short", "e")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(corpus.unionByName(corpus), items).collect()}
    assert got == {(0, 7), (2, 7), (6, 7), (7, 7)}
    pieces = " x ".join(" ".join(words[a : a + 6]) for a in (12, 6, 0))  # in other order, each shorter than twelve words
    moved = texts(spark, [pieces, " ".join(words[:6])], "doc_id")
    assert leaks.leaks(moved, items).count() == 0
    found = [(r.doc_id, r.item_id, r.covered >= 0.5) for r in leaks.leaks(moved, items, min_covered=0.5).collect()]
    assert found == [(0, 7, True)]
    assert leaks.leaks(corpus.limit(0), items).count() == 0 and leaks.leaks(corpus, items.limit(0)).count() == 0


# ------------------------------------------------------------------ subjects


def test_subjects(spark):
    rng = random.Random(9)
    areas = ["sport", "law", "music", "farming", "science", "software"]
    own = {k: [f"{k[:4]}{x}{y}" for x in ("ar", "en", "il") for y in ("ket", "dry", "sum", "pon")] for k in [*areas, None] if k} | {None: "letter window lamp coat wall market street visitor evening garden paper table".split()}
    names = [f"Zan{a}{b}" for a in ("dor", "vel", "kes", "mor") for b in ("by", "ton", "wick", "ley", "mond")]
    rows, truth = [], {}
    for d in range(600):
        about = [None] if d % 10 == 0 else rng.sample(areas, 2) if d % 5 == 0 else [rng.choice(areas)]
        said = [f"The clerk of {rng.choice(names)} saw the {rng.choice(own[k])} and the {rng.choice(own[k])} at noon." for k in about for _ in range(8 // len(about))]
        rng.shuffle(said)
        rows.append((d, " ".join(said), "x"))
        truth[d] = {k for k in about if k}
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, term string")
    labels = spark.createDataFrame([(d, k) for d in range(0, 600, 3) for k in sorted(truth[d])] * 2 + [(1, "sport"), (5, "nonsense")], "doc_id bigint, subject string")
    in_use = spark.createDataFrame([(k,) for k in areas], "subject string")
    model = language.fit(["the clerk saw the man at noon of the day."] * 8, ["eng"] * 8)
    got: dict[int, set] = {}
    for r in subjects.assign_subjects(docs, labels, in_use, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(d, set()) == truth[d] for d in truth)
    assert right >= 0.9 * len(truth) and not set(got) & {900, 901, 902}
    assert subjects.assign_subjects(docs.limit(0), labels, in_use, model).count() == 0


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_leaves_by_labels_and_terms_at_all_sizes(times):
    # leaves: all labelled 0; half of the labels due; none of those due; unlabelled, with the terms of the first
    counts = np.array([[9.0, 0, 1, 0], [0, 9, 1, 0], [0, 0, 1, 9], [9, 0, 1, 0]]) * times
    tagged, due = np.array([[8.0, 0], [0, 4], [0, 0], [0, 0]]) * times, np.array([8.0, 8, 8, 0]) * times
    got = subjects.leaf_subjects(counts, tagged, due)
    assert got.sum(axis=1) == pytest.approx(1) and got.argmax(axis=1).tolist() == [0, got[1].argmax(), 2, 0] and got[1, 1] > 0.4
    votes = subjects.term_subjects(counts, got)
    assert votes[0].argmax() == 0 and votes[1].argmax() == 1 and votes[3].argmax() == 2


def test_terms_of_rare_subjects(spark, monkeypatch):
    # 1000 documents; 90 is in 5 of them and often there, 91 as rare but never twice in one
    rows = [(-1, 1000, 1000), (90, 5, 15), (91, 5, 5), (92, 2, 9), (93, 60, 150), (94, 500, 3000)]
    statistics = spark.createDataFrame(rows, "term bigint, df bigint, cf bigint")
    assert subjects.topical_terms(statistics)[0].tolist() == [90, 93]
    monkeypatch.setattr(subjects, "WIDTH", 1)
    assert subjects.topical_terms(statistics)[1].tolist() == [0, 0]
    assert len(subjects.topical_terms(statistics.limit(0))[0]) == 0
    assert subjects.columns_of(np.array([89, 90, 93, 99]), np.array([90, 93]), np.array([4, 2])).tolist() == [-1, 4, 2, -1]


def test_statistics_of_terms(spark):
    one, two = 7, 2 << 32 | 7
    rows = spark.createDataFrame([(1, [one, two], [2, 1]), (2, [one], [1]), (3, [], [])], "doc bigint, own array<bigint>, times array<int>")
    got = {r.term: (r.df, r.cf) for r in subjects.term_statistics(rows).collect()}
    assert got == {one: (2, 3), two: (1, 1), -1: (2, 2), -3: (1, 1)}


def test_languages_told_by_script(model):
    given = ["彼は古い家を見た。", "কিছু কথা", "ไม่เคยซื้อ", "यह एक पुराना मकान है।", "the man was with this", "12 34", "彼 the man was with this and had"]
    got = subjects.sentence_languages(model, given)
    assert [language.LANGUAGES[i] for i in got[:3]] == ["jpn", "ben", "tha"]
    assert got[3:].tolist() == model.logits(given[3:])[0].argmax(axis=1).tolist()
    assert subjects.sentence_languages(model, []).tolist() == []


def test_headings_are_no_sentences():
    assert subjects.running_sentences("THE MODEST JOURNAL\n\nIt came. It went.") == ["It came.", "It went."]
    assert subjects.running_sentences("") == []


# ------------------------------------------------------------------ queries


@pytest.mark.parametrize("name", ["p2_found", "p6_found", "p8_found"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from vellumetry.llm import queries

    con = duckdb.connect()
    for table in ("ocr_results", "ocr_regions", "scan_volumes", "documents", "eval_items"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, DATA).select(columns).collect()) == sorted(cursor.fetchall())
