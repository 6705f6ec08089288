"""Languages of documents and of the stretches of mixed ones (problem 4).

Method: sparse multinomial logistic regression on TF-IDF character n-grams, hashed into a fixed
number of buckets, trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2
penalties) and calibrated by a temperature on held-out rows. It learns from the labels at hand: a
bounded sample of rows with one language in their label, of which those rows are left out that a model
trained on the other half of the sample would label otherwise.

A text is cut into sentences; each gets the log-probabilities of all languages, and the most likely
sequence with a price for each change of language gives the stretches. A language loses a fixed
amount in a sentence whose letters are mostly of a script it isn't written in.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.canonical import canonical
from vellumetry.llm.sentences import BENGALI, DEVANAGARI, JAPANESE, LATIN, SCRIPT_OF, THAI, sentences

LANGUAGES = ("eng", "fra", "deu", "lat", "spa", "ben", "hin", "san", "jpn", "tha")
# How labels spell the languages, in lower case.
SPELLINGS = {
    "eng": "eng en en-gb en-us english",
    "fra": "fra fr fre fr-fr french francais français",
    "deu": "deu de ger de-de german deutsch",
    "lat": "lat la latin latina",
    "spa": "spa es es-es spanish espanol español castellano",
    "ben": "ben bn bengali bangla",
    "hin": "hin hi hindi",
    "san": "san sa sanskrit",
    "jpn": "jpn ja jp japanese",
    "tha": "tha th thai",
}
# Labels that name no language.
NO_LANGUAGE = ("", "und", "unk", "unknown", "null", "none", "mul", "zxx")

#: Longest n-gram, buckets, labelled texts per language and sentences of one text that the model learns from.
ORDER, BUCKETS, SAMPLE, SAMPLE_SENTENCES = 4, 1 << 16, 300, 4
#: Rates and penalties of the learner, passes, rows per step, and folds, of which one is held out to calibrate.
ALPHA, BETA, L1, L2, PASSES, STEP, FOLDS = 1.0, 1.0, 0.005, 0.005, 2, 32, 6
#: Price in nats of a change of language between sentences; letters from which on a sentence counts in full.
CHANGE, FULL_LETTERS = 2.5, 24
#: Nats a language loses in a sentence most of whose letters are of a script it isn't written in.
OTHER_SCRIPT = 10.0
#: Code points taken at once.
CHUNK = 200_000


def labels_of(column: Column) -> Column:
    """The languages a label names, as an array of codes; empty for a missing label, and for a name that isn't known."""
    known = F.create_map(*(F.lit(x) for code, names in SPELLINGS.items() for name in names.split() for x in (name, code)))
    parts = F.split(F.lower(F.trim(F.coalesce(column, F.lit("")))), r"\s*[+,;/]\s*")
    return F.filter(F.transform(parts, lambda p: F.element_at(known, p)), lambda p: p.isNotNull())


@cache
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter or mark; digits, marks and spaces -> blank."""
    out = np.full(0x30000, 32, np.uint32)
    for o in range(0x30000):
        c = chr(o)
        if c.isalpha() or 0x300 <= o < 0x370 or 0x900 <= o < 0xE80 and not c.isdigit() and o not in (0x964, 0x965) and not 0xE50 <= o <= 0xE59:
            low = c.lower()
            out[o] = ord(low) if len(low) == 1 else o
    return out


@cache
def _scripts() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> number of its script (0: none of these), and which languages each number goes with."""
    names = list(dict.fromkeys(SCRIPT_OF[x] for x in LANGUAGES))
    blocks = {"latin": LATIN, "devanagari": DEVANAGARI, "bengali": BENGALI, "japanese": JAPANESE, "thai": THAI}
    out = np.zeros(0x30000, np.uint8)
    for n, name in enumerate(names, 1):
        pattern = re.compile(f"[{blocks[name]}]")
        for o in range(0x41, 0x10000):
            if pattern.match(chr(o)):
                out[o] = n
    fits = np.array([[not n or SCRIPT_OF[x] == names[n - 1] for x in LANGUAGES] for n in range(len(names) + 1)])
    return out, fits


def ngrams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of the n-grams of each order, with -1 for none, by position; text of each position; letters and main script of each text)."""
    joined = "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    c = _letters()[np.minimum(points, 0x2FFFF)]
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    c, owner, blank = c[keep], owner[keep], blank[keep]
    letters = np.bincount(owner[~blank], minlength=len(texts))
    script = _scripts()[0][c]
    votes = np.bincount(owner * 8 + script, minlength=8 * len(texts)).reshape(-1, 8)[:, 1:]
    script = np.where(votes.max(axis=1) * 2 > votes.sum(axis=1), votes.argmax(axis=1) + 1, 0)
    out, h = [], np.zeros(len(c), np.uint32)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    with np.errstate(over="ignore"):
        for n in range(ORDER):
            if n:
                back = np.zeros_like(c)
                back[n:] = c[:-n]
                ok = np.zeros(len(c), bool)
                ok[n:] = owner[n:] == owner[:-n]
            else:
                back, ok = c, ~blank
            h = (h ^ (back + np.uint32(0x9E37 * (n + 1)))) * np.uint32(0x85EBCA6B)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            out.append(np.where(ok, (mixed >> shift).astype(np.int32), -1))
    return out, owner, letters, script


@dataclass
class Model:
    """weights has the idf of each bucket in it; the last row, for no n-gram, is zero."""

    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits of each text by language, letters of each text)."""
        out = np.zeros((len(texts), len(LANGUAGES)), np.float32)
        letters = np.zeros(len(texts), np.int64)
        lo = size = 0
        for hi, t in enumerate([*texts, ""], 1):
            if hi > len(texts) or size + len(t) > CHUNK:
                part = texts[lo : hi - 1] if hi <= len(texts) else texts[lo:]
                if part:
                    self._part(part, out[lo : lo + len(part)], letters[lo : lo + len(part)])
                    lo, size = lo + len(part), 0
            size += len(t)
        return out, letters

    def _part(self, texts: list[str], out: np.ndarray, letters: np.ndarray) -> None:
        grams, owner, letters[:], script = ngrams(texts)
        starts = np.searchsorted(owner, np.arange(len(texts)))
        total = np.zeros(len(texts), np.int64)
        for g in grams:
            out += np.add.reduceat(self.weights[g], starts, axis=0)
            total += np.add.reduceat((g >= 0).astype(np.int64), starts)
        out /= np.sqrt(np.maximum(total, 1))[:, None]
        out += self.bias
        out -= np.where(_scripts()[1][script], 0, OTHER_SCRIPT * self.temperature).astype(np.float32)

    def log_probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits.astype(np.float64) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _sparse(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, TF-IDF values) of each text."""
    grams, owner, *_ = ngrams(texts)
    g, o = np.concatenate(grams), np.concatenate([owner] * len(grams))
    o, g = o[g >= 0].astype(np.int64), g[g >= 0].astype(np.int64)
    key, count = np.unique(o * BUCKETS + g, return_counts=True)
    o, g = key // BUCKETS, key % BUCKETS
    total = np.bincount(o, weights=count, minlength=len(texts))
    value = count / np.sqrt(np.maximum(total[o], 1)) * idf[g]
    cuts = np.searchsorted(o, np.arange(len(texts) + 1))
    return [(g[a:b], value[a:b].astype(np.float32)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _follow(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader (proximal), in steps of a few rows; bias is a row that every text has."""
    k = len(LANGUAGES)
    z, n = np.zeros((BUCKETS + 1, k), np.float32), np.zeros((BUCKETS + 1, k), np.float32)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            g = np.concatenate([np.append(rows[r][0], BUCKETS) for r in part])
            x = np.concatenate([np.append(rows[r][1], np.float32(1)) for r in part])
            ex = np.repeat(np.arange(len(part)), [len(rows[r][0]) + 1 for r in part])
            touched, where = np.unique(g, return_inverse=True)
            w = weights(touched)
            starts = np.searchsorted(ex, np.arange(len(part)))
            logit = np.add.reduceat(w[where] * x[:, None], starts, axis=0)
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            by = np.argsort(where, kind="stable")
            grad = np.add.reduceat((x[:, None] * p[ex])[by], np.searchsorted(where[by], np.arange(len(touched))), axis=0) / np.sqrt(len(part))
            sigma = (np.sqrt(n[touched] + grad * grad) - np.sqrt(n[touched])) / ALPHA
            z[touched] += grad - sigma * w
            n[touched] += grad * grad
    w = weights(slice(None)).astype(np.float32)
    return w[:BUCKETS], w[BUCKETS]


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """A model from labelled texts; some labels may be wrong. Languages without rows are never predicted."""
    if not texts:
        return Model(np.zeros((BUCKETS + 1, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0)
    y = np.array([LANGUAGES.index(x) for x in labels])
    grams, owner, *_ = ngrams(texts)
    seen = np.unique(np.concatenate([owner[g >= 0] * BUCKETS + g[g >= 0] for g in grams]))
    idf = np.log((1 + len(texts)) / (1 + np.bincount(seen % BUCKETS, minlength=BUCKETS))).astype(np.float32)
    rows = _sparse(texts, idf)
    part = np.array([hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=2).digest()[0] for t in texts]) % FOLDS

    def model_of(chosen: np.ndarray) -> Model:
        w, bias = _follow([rows[i] for i in np.flatnonzero(chosen)], y[chosen], seed)
        return Model(np.vstack([w * idf[:, None], np.zeros((1, len(LANGUAGES)), np.float32)]), bias, 1.0)

    # labels are judged by models that haven't seen them
    agreed = np.ones(len(texts), bool)
    logits = np.zeros((len(texts), len(LANGUAGES)), np.float32)
    for f in range(2):
        inside = part % 2 == f
        if inside.any() and not inside.all():
            logits[inside] = model_of(~inside).logits([t for t, i in zip(texts, inside, strict=True) if i])[0]
            agreed[inside] = logits[inside].argmax(axis=1) == y[inside]
    if not agreed.any():
        agreed[:] = True
    held = agreed & (part == 0)
    learn = agreed & ~held if (agreed & ~held).any() else agreed
    sure = held if held.any() else agreed
    model = model_of(learn)
    logits, _ = model.logits(texts)
    losses = {}
    for t in np.geomspace(0.2, 8, 60):
        model.temperature = float(t)
        losses[float(t)] = -model.log_probabilities(logits[sure])[np.arange(sure.sum()), y[sure]].mean()
    model.temperature = min(losses, key=losses.__getitem__)
    return model


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "ocr_language", id_col: str = "result_id", per_language: int = SAMPLE) -> Model:
    """A model from rows whose label names one language.

    Learns from about per_language texts for each language, chosen by a hash of id and text (at most
    twice that many rows are brought to the driver, and of each text its first SAMPLE_SENTENCES sentences).
    """
    one = labels_of(F.col(label_col))
    rows = labelled.where(F.length(text_col) >= 30).select(F.col(text_col).alias("t"), one.alias("l"), F.xxhash64(id_col, text_col).alias("h")).where(F.size("l") == 1)
    rows = rows.select("t", F.col("l")[0].alias("l"), "h")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    rate = F.create_map(*(F.lit(x) for code, n in counts.items() for x in (code, min(1_000_000, int(1_000_000 * per_language / n) + 1))))
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(rate, F.col("l"))).select("t", "l", "h")
    got = sorted((r["h"], r["t"], r["l"]) for r in sample.orderBy("h", "l").limit(2 * per_language * len(LANGUAGES)).collect())
    texts, labels = [], []
    for _, text, label in got:
        text = canonical(text)
        for a, b in sentences(text)[:SAMPLE_SENTENCES]:
            if b - a >= 12:
                texts.append(text[a:b])
                labels.append(label)
    return fit(texts, labels)


def stretches(scores: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, int]]:
    """(first sentence, sentence after the last, language) of each stretch of the best sequence."""
    k = scores.shape[1]
    weight = np.clip(letters / FULL_LETTERS, 0.05, 1)[:, None]
    e = np.maximum(scores, -20) * weight
    best, back = e[0].copy(), np.zeros((len(e), k), np.int64)
    for i in range(1, len(e)):
        top = int(best.argmax())
        jump = best[top] - CHANGE
        stay = best >= jump
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, jump) + e[i]
    at = int(best.argmax())
    path = [at]
    for i in range(len(e) - 1, 0, -1):
        at = int(back[i][at])
        path.append(at)
    path.reverse()
    out, lo = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[lo]:
            out.append((lo, i, path[lo]))
            lo = i
    return out


def detect(model: Model, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
    """(language, confidence, start, end) of each stretch of each text; texts without letters have none. Offsets are those of the canonical text."""
    texts = [canonical(t) for t in texts]
    cuts = [sentences(t) for t in texts]
    pieces = [t[a:b] for t, spans in zip(texts, cuts, strict=True) for a, b in spans]
    if not pieces:
        return [[] for _ in texts]
    logits, letters = model.logits(pieces)
    scores = model.log_probabilities(logits)
    out, lo = [], 0
    for spans in cuts:
        hi = lo + len(spans)
        own = letters[lo:hi]
        found = []
        if own.any():
            first = scores[lo]
            # most texts have one language, and one look tells
            one = int(first.argmax())
            whole = scores[lo:hi]
            runs = [(0, hi - lo, one)] if (whole.argmax(axis=1) == one).all() else stretches(whole, own)
            for a, b, lang in runs:
                w = np.maximum(own[a:b], 1).astype(np.float64)
                mean = (logits[lo + a : lo + b] * w[:, None]).sum(axis=0, keepdims=True) / w.sum()
                found.append((LANGUAGES[lang], float(np.exp(model.log_probabilities(mean)[0, lang])), spans[a][0], spans[b - 1][1]))
        out.append(found)
        lo = hi
    return out


_models: dict[str, Model] = {}


def identify(texts: DataFrame, model: Model, id_col: str = "result_id", text_col: str = "text", *keep: str) -> DataFrame:
    """One row for each stretch: ({id_col}, kept columns, seg_no, lang, confidence, start_char, end_char, n_segs).

    Texts that are null, blank or without letters give one row with seg_no 0, a null language and
    confidence 0. Narrow: the model (a few MB, fixed by BUCKETS) is broadcast. Repeated rows are repeated.
    """
    data = pickle.dumps(model)
    shared = texts.sparkSession.sparkContext.broadcast(data)
    key = hashlib.blake2b(data, digest_size=8).hexdigest()
    columns = list(dict.fromkeys([id_col, *keep]))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _models.get(key) or _models.setdefault(key, pickle.loads(shared.value))
        for batch in batches:
            rows, out = [], []
            for r, found in enumerate(detect(own, batch.column(len(columns)).to_pylist())):
                for n, f in enumerate(found or [(None, 0.0, 0, 0)]):
                    rows.append(r)
                    out.append((n, *f, len(found)))
            at = pa.array(rows, pa.int64())
            made = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(len(columns))), *(pa.array(m, t) for m, t in zip(made, types, strict=True))],
                names=[*columns, "seg_no", "lang", "confidence", "start_char", "end_char", "n_segs"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    picked = texts.select(*columns, F.col(text_col).alias("_text_"))
    return picked.mapInArrow(run, f"{schema}, seg_no bigint, lang string, confidence double, start_char bigint, end_char bigint, n_segs bigint")
