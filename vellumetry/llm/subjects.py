"""Subject areas of documents (problem 9).

Method: bisecting k-means. Each document is a normalised vector of topical terms, words that come in
bursts (residual IDF within their language: more often in one document than their document frequency
foretells), so languages and names don't drown the subjects. The leaves of the tree are labelled by
the hand labels of their documents and by their discriminative terms, those a leaf has more of than
the corpus; what labels are missing where they are due makes up one more subject, which is never
assigned. A term stands for the mixture of the leaves it occurs in, and so for the subjects these are
labelled with; a sentence has the subject that the mixtures of its terms agree on best, and the
subjects with a large enough share of a document's sentences are assigned.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumetry.llm.canonical import canonical
from vellumetry.llm.language import LANGUAGES, Model
from vellumetry.llm.sentences import BENGALI, DEVANAGARI, JAPANESE, LATIN, THAI, sentences
from vellumetry.session import spread, stored

#: Least share of a document's sentences.
MIN_SHARE = 0.25
#: A topical term: documents it stands in, at most what share of its language's documents, residual IDF.
MIN_DOCS, TO_SHARE, MIN_RIDF = 3, 0.25, 0.22
#: Columns of the vectors; terms beyond so many share them.
WIDTH = 8192
#: Leaves of the tree grow with the cube root of the documents; documents a leaf has on average at least; k-means rounds of each split.
LEAVES, LEAF, ROUNDS = 11.6, 8, 8
#: Documents' worth of labels that a leaf's discriminative terms add to the hand labels in it.
TERMS_COUNT = 0.3
#: Code points of a term in scripts without spaces.
RUN = 5
#: Words a worker keeps with their hashes.
MEMO = 500_000

_KANJI = re.compile("[一-鿿々]{1,8}|[゠-ヿー]{2,}")
_THAI = re.compile("[฀-๿]+")
_UNSPACED = re.compile("[฀-๿぀-ヿ一-鿿]+")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[ऀ-ःऺ-ॏঁ-ঃ়-্])+")
_ENDED = re.compile(r"[.!?।॥|。！？…][”’»“」)）\"'\s]*$")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) < MEMO:
            self[word] = h
        return h


_hash = _Hashes()


def sentence_terms(text: str) -> set[int]:
    """Hashes of a sentence's terms: words, runs of kanji or katakana, RUN code points of Thai."""
    out = set()
    if not text.isascii() and _UNSPACED.search(text):
        out.update(_KANJI.findall(text))
        for run in _THAI.findall(text):
            out.update(run[i : i + RUN] for i in range(len(run) - RUN + 1))
        text = _UNSPACED.sub(" ", text)
    out.update(w for w in _WORD.findall(text.lower()) if len(w) > 2)
    return {_hash[w] for w in out}


def running_sentences(text: str) -> list[str]:
    """A text's sentences without headings: lines by themselves, not ended like a sentence, at the head of the text."""
    found = sentences(text)
    out = [text[a:b] for a, b in found]
    if len(out) > 1 and not _ENDED.search(out[0]) and "\n" not in out[0] and text[found[0][1] : found[1][0]].count("\n") > 1:
        out = out[1:]
    return out


_SHARED_SCRIPT = re.compile(f"[{LATIN}{DEVANAGARI}]")
_OWN_SCRIPT = re.compile(f"([{BENGALI}])|([{JAPANESE}])|([{THAI}])")
_OWN_LANGUAGE = (0, *(LANGUAGES.index(x) for x in ("ben", "jpn", "tha")))


def sentence_languages(model: Model, texts: list[str]) -> np.ndarray:
    """The number of each sentence's language. One without letters of scripts that several languages share is told by its script."""
    out = np.zeros(len(texts), np.int64)
    asked = []
    for i, t in enumerate(texts):
        own = None if t.isascii() or _SHARED_SCRIPT.search(t) else _OWN_SCRIPT.search(t)
        if own:
            out[i] = _OWN_LANGUAGE[own.lastindex]
        else:
            asked.append(i)
    if asked:
        out[asked] = model.logits([texts[i] for i in asked])[0].argmax(axis=1)
    return out


_models: dict[str, Model] = {}


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def term_rows(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(doc, sizes, terms, own, times) of each document, in one Arrow pass: its sentences' numbers of terms, their terms one after the
    other, and the distinct terms with the sentences each stands in. A term's upper half is its sentence's language, the lower its hash.
    """
    data = pickle.dumps(model)
    shared = docs.sparkSession.sparkContext.broadcast(data)  # fixed size
    key = hashlib.blake2b(data, digest_size=8).hexdigest()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = _models.get(key) or _models.setdefault(key, pickle.loads(shared.value))
        for batch in batches:
            cut = [running_sentences(canonical(t)) for t in batch.column(1).to_pylist()]
            flat = [s for c in cut for s in c]
            langs = sentence_languages(own_model, flat)
            found = [sorted(sentence_terms(s)) for s in flat]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            terms = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum())) | np.repeat(langs << 32, sizes)
            doc_of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            of_term = np.repeat(doc_of, sizes)
            order = np.lexsort((terms, of_term))
            t, d = terms[order], of_term[order]
            first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])))) if len(t) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(t)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _lists(sizes, [len(c) for c in cut], pa.int32()),
                    _lists(terms, np.bincount(of_term, minlength=len(cut)).tolist(), pa.int64()),
                    _lists(t[first], np.bincount(d[first], minlength=len(cut)).tolist(), pa.int64()),
                    _lists(times, np.bincount(d[first], minlength=len(cut)).tolist(), pa.int32()),
                ],
                names=["doc", "sizes", "terms", "own", "times"],
            )

    picked = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col)
    return spread(picked).mapInArrow(run, f"doc {kind}, sizes array<int>, terms array<bigint>, own array<bigint>, times array<int>")


def term_statistics(rows: DataFrame) -> DataFrame:
    """(term, df, cf): documents and sentences each term stands in; terms -1 - language: the documents that have any of the language.

    Added up by each task before the shuffle, which is keyed by the term.
    """
    langs = F.transform(F.array_distinct(F.transform("own", lambda t: F.shiftright(t, 32))), lambda x: F.struct((-1 - x).alias("own"), F.lit(1).alias("times")))
    each = rows.select(F.explode(F.concat(F.arrays_zip("own", "times"), langs)).alias("x"))
    return each.groupBy(F.col("x.own").alias("term")).agg(F.count("*").alias("df"), F.sum("x.times").alias("cf"))


def topical_terms(statistics: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms in order, column of each, weight of each) of all topical terms, however rare their subject is.

    The strongest WIDTH terms have a column each, the others share these by hash. Only terms that are
    topical come to the driver, 24 bytes each: a number that grows with the vocabulary, not with the documents.
    """
    n = {-1 - r["term"]: r["df"] for r in statistics.where("term < 0").collect()}  # one row for each language
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    total = F.element_at(F.create_map(*(F.lit(x) for k, v in n.items() for x in (int(k), float(v)))), F.shiftright("term", 32).cast("int"))
    ridf = F.log2(F.col("n") / F.col("df")) + F.log2(1 - F.exp(-F.col("cf") / F.col("n")))
    rows = (
        statistics.where(f"term >= 0 and df >= {MIN_DOCS}")
        .withColumn("n", total)
        .where(F.col("df") <= TO_SHARE * F.col("n"))
        .withColumn("ridf", ridf)
        .where(F.col("ridf") >= MIN_RIDF)
    )
    got = rows.select("term", F.log(F.col("n") / F.col("df")).alias("w"), (F.col("ridf") * F.col("df") / F.col("n")).alias("s")).toArrow()
    term, weight, strength = (got.column(c).to_numpy() for c in ("term", "w", "s"))
    column = ((term >> 32) + term * 31) % WIDTH
    best = np.sort(np.lexsort((term, -strength))[:WIDTH])
    column[best[np.argsort(term[best])]] = np.arange(len(best))
    order = np.argsort(term)
    return term[order], column[order], weight[order]


def columns_of(terms: np.ndarray, known: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The column of each term, -1 for those that aren't topical."""
    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return np.where(known[at] == terms, column[at], -1)


def _vectors(rows: DataFrame, known: np.ndarray, column: np.ndarray, weight: np.ndarray, size: int) -> DataFrame:
    """(doc, features, columns, counts) of each document with a topical term: its normalised vector, made in one Arrow pass and stored."""
    shared = rows.sparkSession.sparkContext.broadcast((known, column, weight))
    kind = dict(rows.dtypes)["doc"]
    empty = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, column, weight = shared.value
        for batch in batches:
            own, times = batch.column(1), batch.column(2)
            c = columns_of(own.flatten().to_numpy(), known, column)
            d = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy())
            keep = c >= 0
            key, where = np.unique(d[keep] * WIDTH + c[keep], return_inverse=True)
            count = np.bincount(where, weights=times.flatten().to_numpy()[keep], minlength=len(key))
            d, c = key // WIDTH, key % WIDTH
            v = np.sqrt(count) * weight[c]
            v /= np.sqrt(np.bincount(d, weights=v * v, minlength=len(batch)))[d]
            rows_, sizes = np.unique(d, return_counts=True) if len(d) else (empty, empty)
            lists = _lists(c, sizes, pa.int32())
            features = pa.StructArray.from_arrays(
                [pa.array(np.zeros(len(rows_)), pa.int8()), pa.array(np.full(len(rows_), size), pa.int32()), lists, _lists(v, sizes, pa.float64())], names=["type", "size", "indices", "values"]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows_)), features, lists, _lists(count, sizes, pa.int32())], names=["doc", "features", "columns", "counts"])

    made = rows.select("doc", "own", "times").mapInArrow(run, f"doc {kind}, features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, columns array<int>, counts array<int>")
    read = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("features", VectorUDT()), T.StructField("columns", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return stored(made, "p9-vectors", read)


def leaf_subjects(counts: np.ndarray, tagged: np.ndarray, due: np.ndarray) -> np.ndarray:
    """The subjects of each leaf, shares that add up to 1; the last is what is about no subject in use.

    counts: leaf x term; tagged: leaf x subject, hand labels; due: labelled documents to be expected in
    each leaf by its size. Labels that are due but missing speak for no subject. A leaf's discriminative
    terms speak for what they were labelled with in all leaves.
    """
    own = np.hstack([tagged, np.maximum(due - tagged.sum(axis=1), 0)[:, None]])
    first = own + 1e-3
    votes = term_subjects(counts, first / first.sum(axis=1, keepdims=True))
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    lift = np.maximum(share - counts.sum(axis=0) / max(counts.sum(), 1e-9), 0)
    said = lift @ votes**2 + 1e-9
    out = own + TERMS_COUNT * said / said.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def term_subjects(counts: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Term x subject: by the mixture of leaves each term occurs in, and as if all subjects were of one size."""
    by = counts.T @ leaves
    by /= np.maximum(by.sum(axis=0, keepdims=True), 1e-9)
    return by / np.maximum(by.sum(axis=1, keepdims=True), 1e-12)


def assign_subjects(
    docs: DataFrame,
    labels: DataFrame,
    subjects: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """({id_col}, subject, share) of each subject that at least min_share of a document's sentences are about.

    labels: (doc_id, subject), some of them wrong or repeated; subjects: the areas in use. Null, empty
    and blank documents have none, and without labels no document has any. The tree and the counts
    come from all documents; what reaches the driver is bounded by WIDTH times the leaves, and the topical terms.
    """
    rows = stored(term_rows(docs, model, id_col, text_col), "p9-terms")
    names = sorted({r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().collect()})
    known, column, idf = topical_terms(stored(term_statistics(rows), "p9-statistics"))
    spark = docs.sparkSession
    result = T.StructType([T.StructField(id_col, rows.schema["doc"].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])
    if not len(known) or not names:
        return spark.createDataFrame([], result)
    size = int(column.max()) + 1
    weight = np.full(size, np.inf)
    np.minimum.at(weight, column, idf)
    vectors = _vectors(rows, known, column, weight, size)

    hand = labels.select(F.col(id_col).alias("doc"), "subject").where(F.col("subject").isin(names)).distinct()
    hand = hand.join(hand.groupBy("doc").agg(F.count("*").alias("k")), "doc")  # a document with two labels counts half for each
    n = vectors.count()
    k = max(2, min(round(LEAVES * n ** (1 / 3)), n // LEAF))
    tree = BisectingKMeans(k=k, maxIter=ROUNDS, seed=7, distanceMeasure="cosine", minDivisibleClusterSize=4.0).fit(vectors)
    placed = stored(tree.transform(vectors).select("doc", F.col("prediction").alias("leaf"), "columns", "counts"), "p9-leaves")
    each = placed.select("leaf", F.explode(F.arrays_zip("columns", "counts")).alias("x")).groupBy("leaf", F.col("x.columns").alias("c")).agg(F.sum("x.counts").alias("m")).toArrow()
    leaf, c, m = (each.column(x).to_numpy() for x in ("leaf", "c", "m"))
    k = int(leaf.max()) + 1
    counts, tagged, held = np.zeros((k, size)), np.zeros((k, len(names))), np.zeros(k)
    counts[leaf, c] = m
    for r in placed.join(hand, "doc").groupBy("leaf", "subject").agg(F.sum(1 / F.col("k")).alias("n")).collect():
        tagged[r["leaf"], names.index(r["subject"])] = r["n"]
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        held[r["leaf"]] = r["n"]
    if not tagged.any():
        return spark.createDataFrame([], result)
    votes = term_subjects(counts, leaf_subjects(counts, tagged, held * tagged.sum() / held.sum()))
    shared = spark.sparkContext.broadcast((known, column, votes))

    def mixtures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, column, votes = shared.value
        none = len(names)
        for batch in batches:
            sizes = batch.column(1).flatten().to_numpy()
            sents = batch.column(1).value_lengths().to_numpy()
            c = columns_of(batch.column(2).flatten().to_numpy(), known, column)
            of = np.repeat(np.arange(len(sizes)), sizes)[c >= 0]
            said = np.zeros((len(sizes), none + 1))
            np.add.at(said, of, votes[c[c >= 0]])
            about = np.where(said.any(axis=1), said.argmax(axis=1), none)
            d = np.repeat(np.arange(len(batch)), sents)
            share = np.bincount(d * (none + 1) + about, minlength=len(batch) * (none + 1)).reshape(-1, none + 1)[:, :none] / np.maximum(sents, 1)[:, None]
            doc, subject = np.nonzero((share > 0) & (share >= min_share - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([names[s] for s in subject], pa.string()), pa.array(share[doc, subject])], names=[id_col, "subject", "share"])

    return rows.select("doc", "sizes", "terms").mapInArrow(mixtures, result)
