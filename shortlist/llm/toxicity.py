"""Toxicity by compression distance with two zstandard dictionaries.

A window is one word with its blanks; each of its bytes is spelt with
``SPREAD`` bytes, so that a letter is long enough for the compressor to match.
One dictionary is trained on words of ordinary texts, the other on words of
toxic texts, and the compressed lengths of a window under both give its
distance. The toxic dictionary is taught the words whose frequency in toxic texts
would surprise in ordinary ones (log-likelihood ratio over ``surprise``); a word
counts in how many different pairs of words it stands, so that copies of a text
do not teach its accidents. The dictionaries match parts of words, so words that no
text of the fit holds get a distance as well.

A text's score comes from its largest distances and from how many of its
windows pass thresholds that are quantiles over ordinary words, through a
logistic calibration on the labelled rows.

Fitting runs on the driver over a bounded sample of labelled rows (``fit``).
Every text is scored, whole. Scores never see labels, lang, source or doc_id.
Empty and null texts get the score of a text without windows. With labels of one
kind only, or none, every text gets the share of toxic labels (0 if none). An
empty table gives an empty result; null and repeated ids are scored like others.
Other columns of any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, held_out, map_batches, pieces, sample_texts, word_hashes

SPREAD, LEVEL, FRAME = 3, 12, 5.0
#: How the trainer cuts segments for the dictionaries: about two windows long.
COVER = {"k": 64, "d": 8}
#: Characters of text that are cut into words at a time, and the words whose distances a worker remembers.
PIECE, MEMO = 1 << 20, 1 << 19
_TABLE = np.stack([np.arange(256, dtype=np.uint8), *(np.random.Generator(np.random.PCG64(70 + i)).permutation(256).astype(np.uint8) for i in range(SPREAD - 1))], 1)


class Words:
    """The words of some texts in lower case: where they stand, their hashes, and the text of each."""

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode() for t in texts]
        self.data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        edge = np.flatnonzero(np.diff(BLANK[self.data].astype(np.int8)))
        self.begin, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.hash = word_hashes(self.data, self.begin, self.end, 41)
        stops = np.cumsum([len(r) + 1 for r in raw])
        self.last = np.searchsorted(self.begin, stops, "right")
        self.count = np.diff(self.last, prepend=0)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def spelt(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The windows of some words one after the other, and the ends of each."""
        size = self.end[at] - self.begin[at] + 2
        ends = np.cumsum(size)
        place = np.repeat(self.begin[at] - 1 - (ends - size), size) + np.arange(size.sum())
        data = self.data[place]
        data[np.concatenate([ends - 1, ends - size])] = 32
        return _TABLE[data].tobytes(), ends * SPREAD


class Counts:
    """The words of texts, in how many different pairs with a neighbour each stands, and its window."""

    def __init__(self, texts: list[str]):
        pairs, windows = [], {}
        for _, some in pieces(pa.array(texts, pa.string()), PIECE):
            w = Words(some)
            new, at = np.unique(w.hash, return_index=True)
            data, ends = w.spelt(at)
            for h, a, b in zip(new.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if h not in windows:
                    windows[h] = data[a:b]
            inside = np.diff(w.owner()) == 0
            a, b = w.hash[:-1][inside], w.hash[1:][inside]
            pairs.append(np.unique(np.stack([a, b], 1), axis=0))
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
        self.hash, self.count = np.unique(both.ravel(), return_counts=True)
        self.total = max(1, int(self.count.sum()))
        self.windows = windows

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, self.count[at], 0)

    def samples(self, hashes: np.ndarray, most: int) -> list[bytes]:
        """The windows of some words, each as often as it has pairs, up to ``most``."""
        return [self.windows[h] for h, n in zip(hashes.tolist(), np.minimum(self.of(hashes), most).tolist(), strict=True) for _ in range(n)]


class Dictionary:
    """A trained dictionary; too few samples are used as they are."""

    def __init__(self, samples: list[bytes], size: int):
        try:
            made = zstandard.train_dictionary(size, samples, level=LEVEL, **COVER).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(samples)[-size:]
        self.content = made
        self._open()

    def __getstate__(self):
        return {"content": self.content}

    def __setstate__(self, state):
        self.content = state["content"]
        self._open()

    def _open(self) -> None:
        own = zstandard.ZstdCompressionDict(self.content)
        own.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

    def lengths(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """The compressed length of each window of ``data``."""
        out = []
        for i in range(0, len(ends), 20_000):
            stop = ends[i : i + 20_000]
            start = np.concatenate([[ends[i - 1] if i else 0], stop[:-1]])
            some = data[start[0] : stop[-1]]
            segments = np.stack([start - start[0], stop - start], 1).astype("<u8").tobytes()
            made = self.compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(some, segments), threads=1)
            out.append(np.fromiter((len(made[k]) for k in range(len(made))), np.int64, len(made)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class ToxicityModel:
    """The two dictionaries, the thresholds and the calibration.

    The bounds of the fit: at most ``most`` samples of a word, ``base`` samples for the
    ordinary dictionary and ``check`` words for the thresholds, of ordinary texts in an
    order drawn by ``seed``; dictionaries of ``plain_size`` and ``toxic_size`` bytes.
    """

    QUANTILES = (0.99, 0.997, 0.9995)

    def __init__(self, ordinary: list[str], toxic: list[str], seed: int = 1, surprise: float = 30.0, most: int = 50, toxic_size: int = 4096, plain_size: int = 32_768, base: int = 80_000, check: int = 30_000):
        self.share = len(toxic) / max(1, len(toxic) + len(ordinary))
        self.weights: np.ndarray | None = None
        self._forget()
        if not toxic or not ordinary:
            return
        # the last fifth of either kind calibrates
        cut = [max(1, len(x) * 4 // 5) for x in (ordinary, toxic)]
        usual = Counts(ordinary[: cut[0]])
        unusual = Counts(toxic[: cut[1]])
        names = np.random.Generator(np.random.PCG64(seed)).permutation(np.sort(usual.hash))
        checked = names[: min(check, len(names) // 2)]
        plain = usual.samples(names[len(checked) :], most)[:base]
        self.plain = Dictionary(plain, plain_size)
        before = self._joined(usual, checked)
        chosen = unusual.hash[self._surprise(unusual, usual) > surprise]
        self.toxic = Dictionary(unusual.samples(chosen if len(chosen) else unusual.hash, most) * 4, toxic_size)
        self.limits = np.quantile(self._ratio(*before, self.toxic), self.QUANTILES) if len(checked) else np.full(3, 0.5)
        self._calibrate(ordinary[cut[0] :] or ordinary, toxic[cut[1] :] or toxic)

    @staticmethod
    def _surprise(toxic: Counts, usual: Counts) -> np.ndarray:
        """The log-likelihood ratio of each word being as frequent in toxic texts as in ordinary ones; 0 where it is rarer."""
        a, b = toxic.count.astype(float), usual.of(toxic.hash) + 0.5
        both = (a + b) / (toxic.total + usual.total)
        ratio = 2 * (a * np.log(a / (both * toxic.total)) + b * np.log(b / (both * usual.total)))
        return np.where(a / toxic.total > b / usual.total, ratio, 0)

    @staticmethod
    def _joined(of: Counts, hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
        own = [of.windows[h] for h in hashes.tolist()]
        return b"".join(own), np.cumsum([len(x) for x in own], dtype=np.int64)

    def _ratio(self, data: bytes, ends: np.ndarray, toxic: Dictionary) -> np.ndarray:
        """What the toxic dictionary saves, as a part of the length under the ordinary one."""
        return 1 - (toxic.lengths(data, ends) - FRAME) / (self.plain.lengths(data, ends) - FRAME)

    def _calibrate(self, ordinary: list[str], toxic: list[str]) -> None:
        x = self.features([*ordinary, *toxic])
        y = np.concatenate([np.zeros(len(ordinary)), np.ones(len(toxic))])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        q = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(q.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(q @ w, -30, 30)))
            step = np.linalg.solve(q.T @ (q * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), q.T @ (p - y) + 0.1 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _forget(self) -> None:
        self.known, self.table = np.zeros(0, np.uint64), np.zeros((0, 2), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _distances(self, w: Words) -> np.ndarray:
        """(part saved, bytes saved) of each window; distances of up to MEMO words are remembered, 16 bytes each."""
        new, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, new)
        at[at == len(self.known)] = 0
        old = self.known[at] == new if len(self.known) else np.zeros(len(new), bool)
        out = np.zeros((len(new), 2), np.float32)
        out[old] = self.table[at[old]]
        if not old.all():
            data, ends = w.spelt(first[~old])
            plain, toxic = self.plain.lengths(data, ends), self.toxic.lengths(data, ends)
            out[~old] = np.stack([1 - (toxic - FRAME) / (plain - FRAME), plain - toxic], 1)
            if len(self.known) + len(new) > MEMO:
                self._forget()
                self.known, self.table = new, out
            else:
                joined = np.concatenate([self.known, new[~old]])
                order = np.argsort(joined)
                self.known, self.table = joined[order], np.concatenate([self.table, out[~old]])[order]
        return out[back]

    def features(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._features(some) for _, some in pieces(pa.array(texts, pa.string()), PIECE)] or [np.zeros((0, 11))])

    def _features(self, texts: list[str]) -> np.ndarray:
        w = Words(texts)
        out = np.zeros((len(texts), 11))
        full = np.flatnonzero(w.count)
        if not len(full):
            return out
        seen, owner, starts = self._distances(w), w.owner(), (w.last - w.count)[full]
        for k in (0, 1):
            left = seen[:, k].copy()
            for turn in (0, 1):
                best = np.maximum.reduceat(left, starts)
                out[full, 2 * k + turn] = np.where(w.count[full] > turn, best, 0)
                # the first of the largest goes, so that the next turn finds the second
                hit = np.flatnonzero(left == np.repeat(best, w.count[full]))
                left[hit[np.unique(owner[hit], return_index=True)[1]]] = -np.inf
        passed = [*(seen[:, 0] > x for x in self.limits), *(seen[:, 1] >= x for x in (3, 5, 7)), np.ones(len(seen))]
        for k, p in enumerate(passed):
            out[:, 4 + k] = np.log1p(np.bincount(owner, p, len(texts)))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_ordinary: int = 6000, max_toxic: int = 3000, max_chars: int = 8 << 20) -> ToxicityModel:
    """Train on a sample of the labelled rows that are not held out.

    Of either kind the first rows by a hash of doc_id, at most ``max_ordinary`` and
    ``max_toxic`` of them and ``max_chars`` characters; a text longer than a sixteenth
    of that is left aside.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select("doc_id", "toxic").distinct()
    sample = []
    for kind, most in ((0, max_ordinary), (1, max_toxic)):
        picked = usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        sample.append(sample_texts(docs, picked, most, max_chars))
    return ToxicityModel(*sample)


def _scored(model: ToxicityModel, column) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a text column with their scores: (first row, scores)."""
    for start, texts in pieces(column, PIECE):
        yield start, model.scores(texts)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own in _scored(shared.value, batch.column("text")):
                ids = batch.column("doc_id").slice(start, len(own))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.float64()), pa.array((own >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, own in _scored(shared.value, batch.column(place)):
                yield batch.slice(start, len(own)).filter(pa.array(own < threshold))

    return map_batches(docs, run, docs.columns, [f.dataType.simpleString() for f in docs.schema])
