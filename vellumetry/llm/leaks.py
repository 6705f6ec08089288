"""Held-out passages inside a corpus (problem 8).

Method: greedy string tiling. Texts become words: canonical form, lower case, marks and breaks of
lines set aside, words divided by a hyphen joined again. Seeds are hashes of SEED words in a row;
winnowing keeps some of them, in such a way that two texts which share min_words words in a row share
a kept seed for certain. Texts that share a seed are tiled: the longest non-overlapping matches are
marked first, found by running Karp-Rabin matching with a falling search length. The longest tile
decides, or, where it is asked for, the tiled share of the held-out passage, whose tiles may stand in
any order; then every seed is kept, so that texts which share MIN_TILE words in a row are tiled.

Letters of scripts without spaces are words of their own that count half.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.llm.canonical import canonical
from vellumetry.session import spread

#: Words in a row that make a leak, words of a seed, and the least tile.
MIN_WORDS, SEED, MIN_TILE = 12, 5, 5
#: Hashes of words a worker keeps.
MEMO = 500_000

UNSPACED = "぀-ヿ㐀-鿿々ｦ-ﾟ฀-๿຀-໿က-႟ក-៿"
_DIVIDED = re.compile("(?<=\\w)[-=\u2010\u2011\u00ad\u00ac\ufe63\uff0d]\\s*\n\\s*(?=\\w)")
_INNER = re.compile(r"(?<=[^\W\d_])['’ʼ`´\-·](?=[^\W\d_])|(?<=\d)[.,](?=\d)")
_WORD = re.compile(rf"[{UNSPACED}]|(?:(?![{UNSPACED}])[^\W_]|[̀-ͯऀ-ःऺ-़ा-ॏ॑-ॗॢॣঁ-ঃ়া-্ৗ])+")
_memo: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = canonical(_DIVIDED.sub("", text)).casefold()
    return _WORD.findall(_INNER.sub("", text))


def numbers(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, the same on every machine."""
    out = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        h = _memo.get(w)
        if h is None:
            data = w.encode("utf-8", "replace")
            h = zlib.crc32(data) << 32 | zlib.adler32(data[::-1] + b"\x01")
            if len(_memo) < MEMO:
                _memo[w] = h
        out[i] = h
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    return h * np.uint64(0x81DADEF4BC2DD44D)


def _hashes(tokens: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the seed at each place."""
    n = max(len(tokens) - seed + 1, 0)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(seed if n else 0):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n])
    return h


def seeds(tokens: np.ndarray, min_words: int = MIN_WORDS, seed: int = SEED) -> np.ndarray:
    """The kept seeds: the least hash of each window of min_words - seed + 1 seeds (winnowing)."""
    h, width = _hashes(tokens, seed), min_words - seed + 1
    if len(h) < width:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    return np.unique(windows.min(axis=1)).view(np.int64)


def tiles(passage: list[str], text: list[str], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in passage, start in text, length), longest first, none overlapping."""
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(passage))}
    p, t = [number[w] for w in passage], [number.get(w, 0) for w in text]
    free_p, free_t = [True] * len(p), [w > 0 for w in t]
    out: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def runs(x: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        """Running Karp-Rabin: (start, hash) of each free run of s words, each hash made from the one before."""
        top, h, n = pow(base, s - 1, mod), 0, 0
        for i, w in enumerate(x):
            if not free[i]:
                h = n = 0
                continue
            if n == s:
                h -= x[i - s] * top
            else:
                n += 1
            h = (h * base + w) % mod
            if n == s:
                yield i - s + 1, h

    s = min(20, max(least, len(p)))
    while s >= least:
        at: dict[int, list[int]] = {}
        for i, h in runs(p, free_p, s):
            at.setdefault(h, []).append(i)
        matches, longest = [], 0
        if at:
            for j, h in runs(t, free_t, s):
                for i in at.get(h, ()):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                        n += 1
                    if n >= s:
                        matches.append((n, i, j))
                        longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                free_p[i : i + n] = [False] * n
                free_t[j : j + n] = [False] * n
                out.append((i, j, n))
        s = s // 2 if s > 2 * least else (least if s > least else 0)
    return sorted(out, key=lambda m: -m[2])


_UNSPACED = re.compile(f"[{UNSPACED}]")


def _count(tokens: list[str]) -> float:
    return sum(0.5 if len(w) == 1 and _UNSPACED.match(w) else 1.0 for w in tokens)


def _seed_rows(texts: DataFrame, id_col: str, text_col: str, min_words: int, name: str) -> DataFrame:
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                got = seeds(numbers(words(text)), min_words)
                if len(got):
                    rows.append(np.full(len(got), r))
                    found.append(got)
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), values], names=[name, "seed"])

    picked = texts.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col))
    return spread(picked).mapInArrow(run, f"{name} {kind}, seed bigint")


def _place_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_i, seed, places, size): every seed of each item with the places it stands at, and the item's words."""
    kind = dict(items.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r, text in enumerate(batch.column(1).to_pylist()):
                tokens = words(text)
                found, times = np.unique(_hashes(numbers(tokens), SEED), return_counts=True)
                rows += [(r, s, n, len(tokens)) for s, n in zip(found.view(np.int64).tolist(), times.tolist(), strict=True)]
            r, *columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=["_i", "seed", "places", "size"])

    picked = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col)).distinct()
    return picked.mapInArrow(run, f"_i {kind}, seed bigint, places bigint, size bigint")


def leaks(
    corpus: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_covered: float | None = None,
) -> DataFrame:
    """(doc_id, item_id, longest, covered) of each document with an item's passage of min_words words or more.

    With min_covered, also of those whose tiles of MIN_TILE words or more cover that share of the item:
    passages in pieces, in any order. longest is the longest tile in words, covered the tiled share of the item's words. Null and short
    texts on either side have none; rows repeated with the same id and text count once. The join of
    seeds and the join of candidates with their texts spread by seed and by document, so neither a hot
    item nor a hot document is gathered in one task; texts without a shared seed aren't shuffled twice.
    """
    if min_covered is None:
        pairs = _seed_rows(corpus, doc_id, text_col, min_words, "_d").join(_seed_rows(items, item_id, text_col, min_words, "_i"), "seed").select("_d", "_i").distinct()
    else:
        # a tile of n words holds n - SEED + 1 seeds, a MIN_TILE-th of its words at least; what shares fewer than the cover takes can't reach it
        met = _seed_rows(corpus, doc_id, text_col, MIN_TILE, "_d").distinct().join(_place_rows(items, item_id, text_col), "seed").groupBy("_d", "_i").agg(F.sum("places").alias("n"), F.max("size").alias("size"))
        pairs = met.where((F.col("n") >= F.ceil(F.col("size") * min_covered / MIN_TILE)) | (F.col("n") >= min_words - SEED + 1)).select("_d", "_i")
    texts = corpus.select(F.col(doc_id).alias("_d"), F.col(text_col).alias("_dt")).where("_dt is not null")
    passages = items.select(F.col(item_id).alias("_i"), F.col(text_col).alias("_it")).where("_it is not null")
    both = texts.join(pairs.join(passages, "_i"), "_d").select("_d", "_i", "_dt", "_it")
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, longest, covered = [], [], []
            for r, (text, passage) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                p = words(passage)
                found = tiles(p, words(text))
                most = max((_count(p[i : i + n]) for i, _, n in found), default=0.0)
                share = sum(n for *_, n in found) / max(len(p), 1)
                if most >= min_words or min_covered is not None and share >= min_covered:
                    keep.append(r)
                    longest.append(most)
                    covered.append(share)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(longest, pa.float64()), pa.array(covered, pa.float64())],
                names=[doc_id, item_id, "longest", "covered"],
            )

    found = both.mapInArrow(run, f"`{doc_id}` {kinds['_d']}, `{item_id}` {kinds['_i']}, longest double, covered double")
    return found.groupBy(doc_id, item_id).agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))
