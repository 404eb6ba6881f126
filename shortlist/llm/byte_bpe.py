"""Byte-level BPE encoding and decoding with a two-tier lookup.

First tier: a minimal perfect hash over the vocabulary resolves every
pre-token that is a token as a whole (its own merges always rebuild it in a
trained rank file; tokens for which they would not are left to the second
tier). Second tier: other pre-tokens are merged with a heap of candidate pairs
over doubly linked bytes, lowest rank first, leftmost first among equals.

Only the vocabulary's tables travel with the tasks (about 1 MB each for 50,000
tokens). Each worker keeps a bounded memo of pre-tokens it has met.

Null and empty texts give no ids. Texts of any length are handled a text at a
time. Lone surrogates cannot occur in Spark strings. Ranks are all different, so
there are no ties but of place, which the leftmost pair wins. Repeated rows have
their ids each; an empty table gives an empty result. Other columns, of any name,
are kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import map_batches, mix, pieces


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def latin(pattern: str) -> str:
    """The pattern for texts of Latin-1 only, with its properties spelt out for Python's faster engine."""
    sets = {r"\p{L}": "L", r"\p{N}": "N"}
    ranges = {}
    for name, kind in sets.items():
        ranges[name] = "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.category(chr(c))[0] == kind)
    ranges[r"\s"] = r"\t-\r \x85\xa0"
    out, inside, i = [], False, 0
    while i < len(pattern):
        step = next((k for k in (*ranges, r"\S") if pattern.startswith(k, i)), pattern[i : i + 2] if pattern[i] == "\\" else pattern[i])
        if step in ranges:
            out.append(ranges[step] if inside else f"[{ranges[step]}]")
        elif step == r"\S" and not inside:
            out.append(f"[^{ranges[r'\s']}]")
        else:
            inside = step == "[" or inside and step != "]"
            out.append(step)
        i += len(step)
    return "".join(out)


class PerfectHash:
    """Minimal perfect hash of n keys to 0..n-1 by levels of bit arrays.

    At each level, keys that alone hash to a position claim it; the others go
    on to the next level. A key's number is the count of claimed positions
    before its own. At most one fingerprint comparison follows.
    """

    def __init__(self, keys: list[bytes]):
        left = hashes = self.hashes(keys)
        self.sizes: list[int] = []
        claimed = []
        while len(left):
            size = 2 * len(left) + 1
            at = self._at(left, len(self.sizes), size)
            level = np.bincount(at, minlength=size) == 1
            claimed.append(level)
            self.sizes.append(size)
            left = left[~level[at]]
            if len(self.sizes) > 64:
                raise ValueError("keys repeat")
        self.claimed = np.concatenate(claimed) if claimed else np.zeros(1, bool)
        self.before = np.cumsum(self.claimed) - self.claimed
        self.n = max(1, int(self.claimed.sum()))
        self.check = np.zeros(self.n, np.uint64)
        self.check[self.slots(hashes)] = hashes

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _at(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The number of each key; any number for what is no key."""
        out, todo, base = np.zeros(len(h), np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._at(h[todo], level, size)
            hit = self.claimed[at]
            out[todo[hit]] = self.before[at[hit]]
            todo, base = todo[~hit], base + size
            if not len(todo):
                break
        return out

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, or -1 where its fingerprint differs; the caller compares the bytes."""
        h = self.hashes(keys)
        slots = self.slots(h)
        return np.where(self.check[slots] == h, slots, -1)


class ByteBPE:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 800_000):
        self.ranks, self.pattern, self.memo = ranks, pattern, memo
        self.single = [ranks[bytes([b])] for b in range(256)]
        tokens = list(ranks)
        self.table = PerfectHash(tokens)
        self.at: list[bytes] = [b""] * self.table.n
        self.id_at = np.full(self.table.n, -1, np.int64)
        for token, slot in zip(tokens, self.table.find(tokens).tolist(), strict=True):
            if self.merge(token) == [ranks[token]]:
                self.at[slot], self.id_at[slot] = token, ranks[token]
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self._open()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find_all", "find_latin", "known", "starts", "flat", "used")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        # the pattern's \\s is Unicode's White_Space, without the separators U+001C to U+001F
        self.find_all, self.find_latin = regex.compile(self.pattern).findall, re.compile(latin(self.pattern)).findall
        self._forget()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_all(text)
        return self.find_latin(text)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.used = np.zeros(1 << 16, np.int64), 0
        self.flat = np.zeros(1 << 18, np.uint32)

    def merge(self, word: bytes) -> list[int]:
        """Merge linked bytes, taking the pair of least rank, then the leftmost, from a heap."""
        n, rank = len(word), self.ranks.get
        if n == 1:
            return [self.single[word[0]]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        if not heap:
            return [self.single[b] for b in word]
        heapify(heap)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it was merged into another
        before = list(range(-1, n - 1))
        while heap:
            r, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            j = before[i]
            if j >= 0 and (r := rank(word[j:stop])) is not None:
                heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, fresh: list[str]) -> None:
        words = [w.encode() for w in fresh]
        slots, merge = self.table.find(words).tolist(), self.merge
        ids = [[int(self.id_at[s])] if s >= 0 and self.at[s] == w else merge(w) for w, s in zip(words, slots, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = self.used, int(sizes.sum())
        base, k = int(self.starts[first]), len(ids)
        while first + k + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while base + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[first + 1 : first + k + 1] = base + np.cumsum(sizes)
        self.flat[base : base + total] = np.fromiter((x for own in ids for x in own), np.uint32, total)
        self.known.update(zip(fresh, range(first, first + k), strict=True))
        self.used += k

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        words = self.split(text)
        if not words:
            return np.zeros(0, np.uint32)
        if self.used > self.memo:
            self._forget()
        if fresh := list(dict.fromkeys(w for w in words if w not in self.known)):
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        start, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        step = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.flat[step + np.arange(len(step))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encode(docs: DataFrame, bpe: ByteBPE, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``token_ids`` (array of int) for ``text``; ``keep`` names the other columns to carry on."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)
    fields = [(i, f) for i, f in enumerate(docs.schema) if (f.name != "token_ids" if keep is None else f.name in keep)]
    place, kept = docs.columns.index(text), [i for i, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            for start, texts in pieces(batch.column(place)):
                ids = [pa.array(coder.encode(t).astype(np.int32), pa.int32()) for t in texts]
                part = batch.slice(start, len(texts))
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays(ids) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), column], [str(i) for i in range(len(kept) + 1)])

    return map_batches(docs, run, [*(f.name for _, f in fields), "token_ids"], [*(f.dataType.simpleString() for _, f in fields), "array<int>"])


def decode(encoded: DataFrame, bpe: ByteBPE, ids: str = "token_ids") -> DataFrame:
    """Add ``decoded`` (binary) for an array of ids; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)
    fields = [(i, f) for i, f in enumerate(encoded.schema) if f.name != "decoded"]
    place, kept = encoded.columns.index(ids), [i for i, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            texts = [x.values.to_numpy() if x.is_valid else None for x in batch.column(place)]
            made = pa.array([None if x is None else coder.decode(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], [str(i) for i in range(len(kept) + 1)])

    return map_batches(encoded, run, [*(f.name for _, f in fields), "decoded"], [*(f.dataType.simpleString() for _, f in fields), "binary"])


def round_trip(docs: DataFrame, bpe: ByteBPE) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256, exact."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
        for batch in batches:
            for start, texts in pieces(batch.column("text")):
                counts, ids_sha, text_sha, exact = [], [], [], []
                for text in texts:
                    ids = coder.encode(text)
                    back = coder.decode(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(back).hexdigest())
                    exact.append(back == text.encode())
                own = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(exact, pa.bool_())], names)

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"
    return docs.select("doc_id", "text").mapInArrow(run, out)
