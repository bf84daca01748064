"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

The automaton reads a training text word by word and holds the longest suffix read so far that
occurs in any item. A window of an item ends where that suffix is long enough; the automaton's state
says in which items it occurs. Words that no item has, and pairs that no item has, part a text into
stretches; only stretches as long as the shortest window can hold one, so only these are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle
from .textbatch import bounded_batches, chunks, pick

#: Words in a window, and the share of hit words from which a text is contaminated.
WINDOW = 13
SHARE = 20
#: Words of items in one automaton. More items are dealt into more automata, each of which reads all texts.
BLOCK_WORDS = 400_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes: digits, letters and all characters beyond ASCII."""
    return text.translate(_TABLE).split()


@dataclass
class SuffixAutomaton:
    """Of several word sequences; ``window`` words of a sequence, or all of a shorter one, are a window."""

    window: int = WINDOW
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    owners: list[set[str]] = field(default_factory=lambda: [set()])
    whole: dict[int, set[str]] = field(default_factory=dict)

    def _state(self, length: int, moves: dict[int, int], link: int, owners: set[str]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(owners)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence read so far and one more word."""
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, {}, 0, set()), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], set())
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def build(self, sequences: list[tuple[str, list[int]]]) -> "SuffixAutomaton":
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        for item, sequence in sequences:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                self.owners[state].add(item)
            if 0 < len(sequence) < self.window:
                self.whole.setdefault(state, set()).add(item)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.owners[self.link[state]] |= self.owners[state] if self.link[state] > 0 else set()
        self._windows()
        return self

    def _windows(self) -> None:
        """For every state: the state of its last ``window`` words, and the whole short items that end it."""
        self.full = [-1] * len(self.length)
        self.short: list[list[int]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[state]
            if self.length[state] >= self.window:
                self.full[state] = state if self.length[up] < self.window else self.full[up]
            self.short[state] = ([state] if state in self.whole else []) + self.short[up]

    def read(self, sequence: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of every window that ends at a word; longest matches are tracked word by word."""
        nexts, links, lengths, full, short, window = self.next, self.link, self.length, self.full, self.short, self.window
        state = held = 0
        for at, word in enumerate(sequence, 1):
            while state and word not in nexts[state]:
                state = links[state]
                held = lengths[state]
            state = nexts[state].get(word, 0)
            held = held + 1 if state else 0
            if held >= window:
                yield at, window, self.owners[full[state]]
            for s in short[state]:
                # A state holds several lengths; the whole item is the longest of its own state.
                if lengths[s] <= held:
                    yield at, lengths[s], self.whole[s]


@dataclass
class Matcher:
    """An automaton with the vocabulary and the word pairs of its items."""

    vocabulary: dict[bytes, int]
    automaton: SuffixAutomaton
    pairs: np.ndarray
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], window: int = WINDOW) -> "Matcher":
        vocabulary: dict[bytes, int] = {}
        sequences = [(i, [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]) for i, text in items]
        sequences = [(i, s) for i, s in sequences if s]
        pairs = {a * len(vocabulary) + b for _, s in sequences for a, b in zip(s, s[1:])}
        shortest = min((min(len(s), window) for _, s in sequences), default=window)
        return cls(vocabulary, SuffixAutomaton(window).build(sequences), np.array(sorted(pairs), dtype=np.int64), shortest)

    def hits(self, tokens: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are inside a window, and the items whose windows occur."""
        n = len(tokens)
        hit, found = np.zeros(n, dtype=bool), set()
        if n < self.shortest or not self.vocabulary:
            return hit, found
        ids = np.fromiter(map(self.vocabulary.get, tokens, [-1] * n), dtype=np.int64, count=n)
        known = ids >= 0
        if self.shortest == 1:
            joined = known[1:] & known[:-1]
        else:
            key = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.searchsorted(self.pairs, key)
            joined = known[1:] & known[:-1] & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key) if len(self.pairs) else np.zeros(n - 1, dtype=bool)
        # Stretches of known words in which every neighbouring pair is known.
        begins = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = ends - begins >= self.shortest
        for lo, hi in zip(begins[long].tolist(), ends[long].tolist()):
            for end, length, items in self.automaton.read(ids[lo:hi].tolist()):
                hit[lo + end - length : lo + end] = True
                found |= items
        return hit, found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``limit`` words; one block is in memory at a time."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        text = (row["text"] or "").encode()
        block.append(("null" if row["id"] is None else str(row["id"]), text))
        size += len(words(text))
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Find the words of documents that are inside a window of a benchmark item.

    Returns one row for each input row: id, n_words, n_hit, n_items, items (sorted strings), spans
    (of hit words: start and end, end exclusive), contaminated (n_hit > 0 and share * n_hit >=
    n_words). Null and empty texts have no words; items without words have no windows; equal items
    are all named; a null item id is named "null". An empty table gives no rows, an empty benchmark
    no hits. Other columns are ignored.

    The benchmark is read in blocks of at most ``block_words`` words (and one item), each of which
    makes one automaton; every block's automaton reads all texts, and hit words of all blocks unite.
    """
    read = _read(pick(docs, id=doc_id, text=text), pick(benchmark, id=item_id, text=item_text), "text", window, block_words)
    n_hit = _n_hit(F.col("__spans"))
    return read.select(
        "id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.col("__items").alias("items"),
        F.col("__spans").alias("spans"),
        _is_contaminated(share).alias("contaminated"),
    )


def _read(rows: DataFrame, benchmark: DataFrame, text: str, window: int, block_words: int) -> DataFrame:
    """``rows`` with __n_words, __spans and __items, block by block; rows stay where they are, so nothing is shuffled."""
    bounded_batches(rows.sparkSession)
    at = rows.columns.index(text)
    none = [F.lit(0).cast("long").alias("__n_words"), F.array().cast("array<int>").alias("__spans"), F.array().cast("array<string>").alias("__items")]
    state = rows.select(*rows.columns, *none)
    schema = state.schema
    held: list[DataFrame] = []
    for k, block in enumerate(_blocks(benchmark, block_words)):
        if k:
            # One automaton is in a task at a time: a further block starts from a table, which replaces the last one.
            state = settle(state, "decontamination")
            discard(*held)
            held = [state]
        state = state.mapInArrow(_pass(rows.sparkSession.sparkContext.broadcast(Matcher.of(block, window)), at), schema)
    return state


def _n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("sign")), _add_span).getField("sum")


def _is_contaminated(share: int) -> Column:
    n_hit = _n_hit(F.col("__spans"))
    return (n_hit > 0) & (n_hit * share >= F.col("__n_words"))


def _add_span(state, edge):
    """Ends count with plus and starts with minus, in turn."""
    return F.struct((state["sum"] + edge * state["sign"]).cast("long").alias("sum"), (-state["sign"]).alias("sign"))


def _pass(shared, at: int):
    """A reader of batches that end in __n_words, __spans and __items; the text is column ``at``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            counts, spans, items = [], batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            k = 0
            for chunk in chunks(pa.record_batch([batch.column(at)], names=["text"])):
                for row in range(chunk.hi - chunk.lo):
                    tokens = words(chunk.text(row))
                    counts.append(len(tokens))
                    hit, found = matcher.hits(tokens)
                    if found:
                        for a, b in zip(spans[k][::2], spans[k][1::2]):
                            hit[a:b] = True
                        spans[k] = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                        items[k] = sorted({*items[k], *found})
                    k += 1
            made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *made], names=batch.schema.names)

    return read


def remove_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans (starts and ends in turn) and what stands between them."""
    if not spans:
        return text
    lowered = np.frombuffer(text.translate(_TABLE), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], lowered.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    kept, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(text[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*kept, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int | None = None, window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without contamination, in their own columns.

    Rows that ``contamination`` calls contaminated (their hit words exceed the coverage limit) go.
    With ``max_words``, hit spans of more words are cut out of the texts of the other rows. Every row
    is judged by itself, so ids need not be there or be unique; null texts stay null.
    """
    read = _read(docs, pick(benchmark, id=item_id, text=item_text), text, window, block_words).where(~_is_contaminated(share))
    if max_words is None:
        return read.select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        def one(t, spans):
            pairs = [x for a, b in zip(spans[::2], spans[1::2]) if b - a > max_words for x in (int(a), int(b))]
            return remove_spans(t.encode(), pairs).decode()

        return pd.Series([t if t is None else one(t, s) for t, s in zip(texts, all_spans)], dtype=object)

    # Only texts with a long span are sent to be cut.
    spans = read["__spans"]
    long = F.size(F.filter(spans, lambda end, at: (at % 2 == 1) & (end - F.get(spans, at - 1) > max_words))) > 0
    return read.select(*[F.coalesce(cut(F.when(long, read[c]), spans), read[c]).alias(c) if c == text else read[c] for c in docs.columns])
