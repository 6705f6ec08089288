"""Encoding with a byte-level BPE vocabulary (problem 7).

Method: prefix dynamic programming. The encoding of every byte prefix of a piece of text is unique,
so it is enough to store, for each prefix, its last token: the one token that ends there and may
stand after the last token of the prefix before it. Two tokens may stand together if encoding their
joined bytes gives just these two. Stored prefixes make appends exact and cheap (only new bytes are
looked at), and after an edit only the pieces around it are split and encoded again.

Texts are first split by the vocabulary's pattern. Pieces repeat, so each worker keeps the ids of
those it has met. Null and empty texts get the empty list. No special tokens are ever produced;
their spellings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumetry.session import spread

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
#: Bytes that a vocabulary file may have to be broadcast; the known ones have under 1 MB.
MAX_VOCABULARY_BYTES = 16 << 20
#: Pieces whose ids a worker keeps, and token pairs whose verdict it keeps; beyond that they are worked out each time.
MEMO_PIECES, MEMO_PAIRS = 200_000, 500_000
# Fixed value: how byte_bpe_50k splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Tokens and ranks of one byte-level BPE."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.split = regex.compile(pattern)
        tails: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        #: last three bytes -> lengths of the tokens that end so, longest first
        self.tails = {t: tuple(sorted(n, reverse=True)) for t, n in tails.items()}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """BPE by its definition: join the pair of lowest rank, leftmost first, until none is left. For short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def together(self, a: bytes, b: bytes) -> bool:
        """May b follow a in an encoding? Also false if either isn't the encoding of its own bytes."""
        got = self._pairs.get((a, b))
        if got is None:
            got = self.merge(a + b) == [a, b]
            if len(self._pairs) < MEMO_PAIRS:
                self._pairs[a, b] = got
        return got

    def extend(self, data: bytes, last: list[bytes]) -> None:
        """Fills last, where last[i] is the last token of data[:i] (last[0] is empty), up to the end of data."""
        ranks, tails, together, pairs = self.ranks, self.tails, self.together, self._pairs
        for i in range(len(last), len(data) + 1):
            for n in (*tails.get(data[i - 3 : i], ()), 2, 1) if i > 2 else (2, 1):
                if n > i:
                    continue
                token = data[i - n : i]
                if token not in ranks:
                    continue
                if n == i:
                    ok = n == 1 or self.merge(token) == [token]
                else:
                    before = last[i - n]
                    ok = pairs.get((before, token))
                    if ok is None:
                        ok = together(before, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {data[i - 1]}")

    def ids_of(self, last: list[bytes]) -> tuple[int, ...]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(self.ranks[last[i]])
            i -= len(last[i])
        return tuple(reversed(out))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        if whole is not None and self.merge(data) == [data]:
            got: tuple[int, ...] = (whole,)
        else:
            last = [b""]
            self.extend(data, last)
            got = self.ids_of(last)
        if len(self._pieces) < MEMO_PIECES:
            self._pieces[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        out: list[int] = []
        if not text:
            return out
        known, piece = self._pieces.get, self.piece
        for p in self.split.findall(text):
            out += known(p) or piece(p)
        return out


class Encoded:
    """A text with its pieces' prefix tables, for exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.pieces: list[tuple[bytes, list[bytes]]] = []
        self.append(text)

    def ids(self) -> list[int]:
        return [i for _, last in self.pieces for i in self.vocabulary.ids_of(last)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end]; gives the number of pieces that were split anew.

        The pattern never looks back and at most two characters past a piece, so everything before the
        first piece that ends at start - 1 or later stays, and so does everything from the first old boundary met again.
        """
        old_starts, old_pieces, old_length = self.starts, self.pieces, len(self.text)
        text = self.text[:start] + new + self.text[end:]
        shift = len(text) - old_length
        ends = [*old_starts[1:], old_length] if old_starts else []
        keep = bisect_left(ends, start - 1)
        at = old_starts[keep] if keep < len(old_starts) else (ends[-1] if ends else 0)
        starts, pieces = old_starts[:keep], old_pieces[:keep]
        tail = {s + shift: k for k, s in enumerate(old_starts) if s >= end}
        done = 0
        for m in self.vocabulary.split.finditer(text, at):
            if m.start() >= start + len(new) and (k := tail.get(m.start())) is not None:
                starts += [s + shift for s in old_starts[k:]]
                pieces += old_pieces[k:]
                break
            data = m.group().encode("utf-8", "replace")
            last = [b""]
            if done == 0 and keep < len(old_pieces):  # the piece that was cut or grown: prefixes in common are known
                same = len(os.path.commonprefix([data, old_pieces[keep][0]]))
                last = old_pieces[keep][1][: same + 1]
            self.vocabulary.extend(data, last)
            starts.append(m.start())
            pieces.append((data, last))
            done += 1
        self.text, self.starts, self.pieces = text, starts, pieces
        return done


_loaded: dict[int, Vocabulary] = {}


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", tokenizers: str = TOKENIZERS) -> DataFrame:
    """({id_col}, ids ARRAY<INT>) of each row; null and empty texts get an empty list.

    Narrow: no shuffle, two columns read. Repeated rows are repeated; other columns are left out. The
    vocabulary is read once by the driver and broadcast; its size is checked.
    """
    path = os.path.join(tokenizers, vocabulary)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        shared = texts.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        vocab = _loaded.get(key) or _loaded.setdefault(key, Vocabulary(shared.value))
        for batch in batches:
            ids = pa.array([vocab.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return spread(texts.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
