"""Ranked lexical search with variable blocks.

The index is made of shards: a few megabytes of documents with their postings, each written by the
task that reads them, so nothing is shuffled to build it. A search reads the shards twice. First it
sums the documents that hold each term of the items. Then every shard cuts the postings of these
terms into blocks and keeps of each block the largest score of its postings. Where blocks begin is
chosen by dynamic programming, so that block maxima are as little above the scores as can be for a
price per block. A document can be among the best only if the maxima of the blocks that cover it,
summed over an item's terms, reach the score of the worst document held so far, and if it has one of
the terms without which the others can't reach it; this is tested for all documents of a shard at
once, and whatever fails is skipped. What remains is scored exactly, best bound first. A task carries its worst scores from shard to shard and returns
its best documents once.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .alignment import from_planes, planes
from .storage import settle
from .textbatch import Chunk, ascii_lower, bounded_batches, byte_class, chunks, pick, span_hash, spans

#: Bytes of text in a shard; it ends with the text that reaches them.
SHARD_BYTES = 8 << 20
#: Terms (with repeats) of the items that are searched at a time.
BLOCK_TERMS = 400_000
#: Postings of the longest block, and what a block costs against the sum of what its maximum is above its scores, as a part of the largest score.
LONGEST = 64
PRICE = 0.25
#: Documents that a shard scores before its bounds are compared with what they reach.
FIRST = 64
#: Results of an item.
BEST = 10

# The score's constants.
SCALE, SLOPE, FREE, BOUND = 1_000_000_000, 8, 10, 90

_TERM = ~byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LOWER = ascii_lower()


def terms_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a chunk, in order of the texts, and the row of each."""
    starts, ends, rows = spans(chunk, _TERM)
    return span_hash(_LOWER[chunk.data], starts, ends), rows


def counted(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, rows and how often each term is in each row, sorted by term and row."""
    order = np.lexsort((rows, terms))
    terms, rows = terms[order], rows[order]
    cuts = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])))[: len(terms)])
    return terms[cuts], rows[cuts], np.diff(np.append(cuts, len(terms)))


# The index.

_SHARD = "sizes binary, terms binary, holders binary, places binary, times binary"


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in chunks(batch):
                terms, rows = terms_of(chunk)
                held.append((batch.column("id").slice(chunk.lo, chunk.hi - chunk.lo), np.bincount(rows, minlength=chunk.hi - chunk.lo), *counted(terms, rows)))
                size += len(chunk.data)
                if size >= limit:
                    yield _shard(held)
                    held, size = [], 0
        if held:
            yield _shard(held)

    return run


def _shard(held: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([i for i, *_ in held])
    first = np.cumsum([0, *(len(i) for i, *_ in held)])
    terms, rows, times = np.concatenate([t for *_, t, _, _ in held]), np.concatenate([r + s for s, (*_, r, _) in zip(first, held)]), np.concatenate([n for *_, n in held])
    order = np.lexsort((rows, terms))
    terms, rows, times = terms[order], rows[order], times[order]
    entries, holders = np.unique(terms, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    # Rows rise within a term, so their differences are small and compress well.
    data = [planes(np.concatenate([n for _, n, *_ in held])), entries.tobytes(), planes(holders), planes(_stepped(rows, holders)), planes(times)]
    return pa.record_batch([lists, *[pa.array([d], pa.binary()) for d in data]], names=["ids", "sizes", "terms", "holders", "places", "times"])


def _stepped(rows: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """Differences of rows within the postings of each term."""
    step = np.diff(rows, prepend=0)
    first = np.concatenate(([0], np.cumsum(holders)[:-1]))[: len(holders)]
    step[first] = rows[first]
    return step


@dataclass(frozen=True)
class Shard:
    sizes: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    steps: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int) -> "Shard":
        data = {name: batch.column(name)[k].as_py() for name in ("sizes", "terms", "holders", "places", "times")}
        starts = np.concatenate(([0], np.cumsum(from_planes(data["holders"]))))
        return cls(from_planes(data["sizes"]), np.frombuffer(data["terms"], np.uint64), starts, from_planes(data["places"]), from_planes(data["times"]))

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``terms`` the shard has, and where in its own."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        return known, at[known]


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: the ids of its documents, their numbers of terms, and postings of all terms, in bytes."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    return settle(rows.mapInArrow(_shards(shard_bytes), f"ids array<{kind}>, {_SHARD}"), "lexical-index")


# The search.


def variable_blocks(scores: np.ndarray, starts: np.ndarray, price: float, longest: int = LONGEST) -> np.ndarray:
    """Where blocks begin in lists of scores, of which ``starts`` has the bounds: no choice of blocks of at most
    ``longest`` postings has a smaller sum of price per block and of what block maxima are above the scores.

    All lists are done at once, posting by posting: the best cost of the first i postings is that of
    the first j and of a block from there, for the best of the last ``longest`` j.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    sizes, begin = sizes[order], starts[:-1][order]
    n = len(sizes)
    # Column c is the block that began at the last posting whose number is c modulo ``longest``: the best
    # cost before it (and the sum of scores before it), and its maximum so far.
    before, most = np.full((n, longest), np.inf), np.zeros((n, longest))
    best, total = np.zeros(n), np.zeros(n)
    back = np.zeros(len(scores), dtype=np.int64)
    columns = np.arange(longest)
    for i in range(int(sizes[0]) if n else 0):
        live = int(np.searchsorted(-sizes, -(i + 1), side="right"))
        x = scores[begin[:live] + i].astype(np.float64)
        before[:live, i % longest] = best[:live] + total[:live]
        most[:live, i % longest] = 0
        np.maximum(most[:live], x[:, None], out=most[:live])
        total[:live] += x
        lengths = (i - columns) % longest + 1
        cost = before[:live] + most[:live] * lengths
        choice = cost.argmin(axis=1)
        best[:live] = cost[np.arange(live), choice] + price - total[:live]
        back[begin[:live] + i] = lengths[choice]
    # From the end of every list back to its beginning.
    first = np.zeros(len(scores) + 1, dtype=bool)
    at, low = starts[1:][np.diff(starts) > 0], starts[:-1][np.diff(starts) > 0]
    while len(at):
        at = at - back[at - 1]
        first[at] = True
        left = at > low
        at, low = at[left], low[left]
    return np.flatnonzero(first[:-1])


@dataclass(frozen=True)
class Items:
    """Items searched together: their distinct terms, sorted, with weights; and the terms of each as positions among these."""

    terms: np.ndarray
    weights: np.ndarray
    own: list[np.ndarray]


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all terms of documents with repeats."""

    documents: int
    words: int

    def length_terms(self, sizes: np.ndarray) -> np.ndarray:
        return FREE + (BOUND * sizes * self.documents) // max(self.words, 1)


class Postings:
    """The postings of the items' terms in one shard, with their blocks."""

    def __init__(self, shard: Shard, items: Items, corpus: Corpus, longest: int, price: float):
        known, at = shard.find(items.terms)
        self.at = np.full(len(items.terms), -1)
        self.at[known] = np.arange(len(known))
        counts = shard.starts[at + 1] - shard.starts[at]
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        pick = np.arange(self.starts[-1]) + np.repeat(shard.starts[at] - self.starts[:-1], counts)
        step = np.cumsum(shard.steps[pick]) if len(pick) else np.zeros(0, np.int64)
        self.rows = step - np.repeat(np.concatenate(([0], step))[self.starts[:-1]], counts)
        times = shard.times[pick]
        self.scores = (SCALE * times) // (1000 * times + SLOPE * corpus.length_terms(shard.sizes)[self.rows])
        self.weights = items.weights[known]
        first = variable_blocks(self.scores, self.starts, price * SCALE / 1000, longest)
        last = np.append(first[1:], len(self.scores))[: len(first)] - 1
        self.block_starts = np.searchsorted(first, self.starts)
        self.low, self.high = self.rows[first], self.rows[last]
        self.most = np.maximum.reduceat(self.scores, first) if len(first) else np.zeros(0, np.int64)
        self.peaks = self.weights * (np.maximum.reduceat(self.most, self.block_starts[:-1]) if len(first) else np.zeros(0, np.int64))
        self.n = len(shard.sizes)

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.at[terms][self.at[terms] >= 0]

    def bounds(self, lists: np.ndarray) -> np.ndarray:
        """For each document the sum of the weighted maxima of the blocks that cover it; sums are below 2**53, so doubles hold them."""
        parts = [slice(self.block_starts[k], self.block_starts[k + 1]) for k in lists.tolist()]
        weighted = np.concatenate([self.weights[k] * self.most[p] for k, p in zip(lists.tolist(), parts)]).astype(np.float64)
        low, high = np.concatenate([self.low[p] for p in parts]), np.concatenate([self.high[p] for p in parts])
        change = np.bincount(low, weighted, self.n + 1) - np.bincount(high + 1, weighted, self.n + 1)
        return np.cumsum(change)[:-1]

    def pivots(self, lists: np.ndarray, floor: int) -> np.ndarray:
        """Whether each document is in a list without which the others can't reach ``floor`` together."""
        order = lists[np.argsort(self.peaks[lists])]
        out = np.zeros(self.n, dtype=bool)
        for k in order[np.cumsum(self.peaks[order]) >= floor].tolist():
            out[self.rows[self.starts[k] : self.starts[k + 1]]] = True
        return out

    def exact(self, lists: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of the sorted ``rows``; postings are looked up, not read through."""
        out = np.zeros(len(rows), dtype=np.int64)
        for k in lists.tolist():
            own = self.rows[self.starts[k] : self.starts[k + 1]]
            at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            hit = own[at] == rows
            out[hit] += self.weights[k] * self.scores[self.starts[k] + at[hit]]
        return out

    def best(self, terms: np.ndarray, floor: int, best: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of all documents that may be among the ``best``, with a score of ``floor`` or more."""
        lists = self.of(terms)
        none = np.zeros(0, np.int64)
        if not len(lists):
            return none, none
        bounds = self.bounds(lists)
        near = np.flatnonzero((bounds >= max(floor, 1)) & self.pivots(lists, max(floor, 1)))
        if len(near) > first:
            # The likeliest documents are those of the term that can add most, if there are enough of them.
            lead = lists[np.argmax(self.peaks[lists])]
            own = np.intersect1d(near, self.rows[self.starts[lead] : self.starts[lead + 1]])
            top = own if len(own) >= best else near
            top = np.sort(top[np.argsort(-bounds[top])[:first]])
            reached = self.exact(lists, top)
            if first >= best:
                floor = max(floor, int(np.partition(reached, -best)[-best]))
            near = near[(bounds[near] >= floor) & self.pivots(lists, floor)[near]]
        scores = self.exact(lists, near)
        good = scores >= max(floor, 1)
        return near[good], scores[good]


def _documents_of(known: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, n): in how many documents of a task's shards each term of the items is."""
        terms = known.value
        n = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column("terms")[k].as_py(), np.uint64)
                at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                hit = np.flatnonzero(own[at] == terms) if len(own) else []
                n[hit] += from_planes(batch.column("holders")[k].as_py())[at[hit]] if len(own) else 0
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(terms[some].view(np.int64)), pa.array(n[some])], names=["term", "n"])

    return run


def _searched(known: Broadcast, corpus: Corpus, best: int, longest: int, price: float, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, id, score): the best documents of a task's shards for each item, by position among the items."""
        items: Items = known.value
        held: list[list[tuple]] = [[] for _ in items.own]
        floors = [1] * len(items.own)
        kind = None
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values
                kind = ids.type
                postings = Postings(Shard.of(batch, k), items, corpus, longest, price)
                for i, terms in enumerate(items.own):
                    rows, scores = postings.best(terms, floors[i], best, first)
                    if len(rows):
                        # Ids are compared as they are; a document without one comes last.
                        named = zip((-scores).tolist(), ids.take(pa.array(rows)).to_pylist())
                        held[i] = sorted([*held[i], *((s, x is None, x) for s, x in named)], key=_in_order)[:best]
                        if len(held[i]) == best:
                            floors[i] = -held[i][-1][0]
        if kind is not None:
            rows = [(i, x, -s) for i, found in enumerate(held) for s, _, x in found]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    return run


def _in_order(found: tuple) -> tuple:
    score, missing, own = found
    return (score, missing) if missing else (score, missing, own)


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items (id and hashes of their distinct terms) in blocks of about ``limit`` terms; one block is in memory at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        batch = pa.record_batch([pa.array([row["text"]], pa.string())], names=["text"])
        terms = np.unique(np.concatenate([terms_of(chunk)[0] for chunk in chunks(batch)]))
        block.append((row["id"], terms))
        size += len(terms)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def weight(documents: Column, total: int) -> Column:
    """A term's weight from the documents that hold it, of ``total``."""
    return F.floor(F.lit(1000) * F.ln((F.lit(2 * total) + 2).cast("double") / (documents * 2 + 1)))


def search(
    index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", best: int = BEST, block_terms: int = BLOCK_TERMS, longest: int = LONGEST, price: float = PRICE, first: int = FIRST
) -> DataFrame:
    """The ``best`` documents of an index for each item: item_id, rank (from 1), id, score.

    A term is a run of letters, digits and characters beyond ASCII, without case of A-Z. A document's
    score for an item is the sum over the item's distinct terms of weight * ((10**9 * times) div
    (1000 * times + 8 * m)), where times is how often the document has the term, m is 10 + (90 * its
    terms * documents) div (all terms), and the weight floor(1000 * ln((2 * documents + 2) / (2 *
    holders + 1))). Only documents with a term count as documents. Scores of 0 are no results; of
    equal scores the smaller id comes first, null ids last.

    Null and empty items, and items without a term in any document, have no results. Rows that repeat
    an item are items of their own with results of their own; rows that repeat a document are each
    a result. An empty index gives no rows. Other columns are ignored.

    Items are read in blocks of at most ``block_terms`` terms (and one item), each of which is sent to
    every task and read against all shards.
    """
    spark = index.sparkSession
    bounded_batches(spark)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows = pick(items, id=item_id, text=text)
    item_type = rows.schema["id"].dataType
    # Sizes of documents are a few bytes each, so only this column is read for the totals.
    totals = index.select("sizes").mapInArrow(_totals, "documents long, words long").agg(F.sum("documents").alias("documents"), F.sum("words").alias("words")).first()
    corpus = Corpus(totals["documents"] or 0, totals["words"] or 0)
    out = None
    for block in _item_blocks(rows, block_terms):
        terms = np.unique(np.concatenate([t for _, t in block]))
        known = spark.sparkContext.broadcast(terms)
        holders = index.select("terms", "holders").mapInArrow(_documents_of(known), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        weighed = {r["term"]: r["weight"] for r in holders.select("term", weight(F.col("n"), corpus.documents).alias("weight")).collect()}
        weights = np.array([weighed.get(t, 0) for t in terms.view(np.int64).tolist()], dtype=np.int64)
        shared = spark.sparkContext.broadcast(Items(terms, weights, [np.searchsorted(terms, t) for _, t in block]))
        found = index.mapInArrow(_searched(shared, corpus, best, longest, price, first), f"item int, id {kind}, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {item_type.simpleString()}")
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, id {kind}, score long")
    return out


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [from_planes(data) for data in batch.column("sizes").to_pylist()]
        yield pa.record_batch([pa.array([int((s > 0).sum()) for s in sizes], pa.int64()), pa.array([int(s.sum()) for s in sizes], pa.int64())], names=["documents", "words"])
