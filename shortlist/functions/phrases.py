"""Many phrases found in one pass over each text, by an automaton (Aho-Corasick)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What patterns call a word character.
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]")


@functools.lru_cache(1 << 16)
def _fold(c: str) -> str:
    """One character for the same letter in any case; those whose other case is longer stay."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


@functools.lru_cache(1 << 16)
def _is_word(c: str) -> bool:
    return WORD.match(c) is not None


def fold(text: str) -> str:
    """The text in one case, character by character, so that places stay."""
    return text.lower() if text.isascii() else "".join(map(_fold, text))


class Phrases:
    """A set of phrases; ``find`` gives those that stand in a text, in any case, touched by no word character."""

    def __init__(self, phrases: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            folded = fold(p)
            if folded:
                self.automaton.add_word(folded, (len(folded), [*self.automaton.get(folded, (0, []))[1], i]))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[int]:
        """The numbers of the phrases, in order."""
        if self.empty or not text:
            return []
        text, found = fold(text), []
        end = len(text) - 1
        for last, (size, numbers) in self.automaton.iter(text):
            if (last == end or not _is_word(text[last + 1])) and (last < size or not _is_word(text[last - size])):
                found += numbers
        return sorted(set(found)) if len(found) > 1 else found

    def find_all(self, texts: pa.Array) -> pa.Array:
        """The numbers for each text; a text that stands there several times is walked through once."""
        different = texts.dictionary_encode()
        found = pa.array([self.find(t) for t in different.dictionary.to_pylist()], pa.list_(pa.int32()))
        return found.take(different.indices).fill_null([])


def with_phrases(df: DataFrame, key: str, columns: dict[str, list[str]]) -> DataFrame:
    """(key, a column for each of ``columns``): the numbers of the phrases of its list that each text column holds, found in one scan.

    The lists are configuration: they travel with the task. A text is walked through once, however many phrases there are.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = list(columns)
    kind = df.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), *[(n, pa.list_(pa.int32())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Phrases(columns[n]) for n in names]
        for batch in batches:
            found = [a.find_all(batch.column(i)) for i, a in enumerate(automata, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], schema=schema)

    return df.select(key, *names).mapInArrow(run, ", ".join([f"`{key}` {kind.simpleString()}", *[f"`{n}` array<int>" for n in names]]))
