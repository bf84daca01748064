"""SimHash near duplicates by a hierarchical index over Gray-ordered fingerprints.

A node of the index is a masked bit pattern; its members are the fingerprints that carry it. The
root's children fix one of three blocks of bits: fingerprints that differ in two bits or fewer agree
in one block at least, so they meet in some child. A node with many members gets children of its
own, which fix one of three blocks of the bits that are still free, down to at most 4,096 members a
node whatever the data. Spark deals the nodes out in Gray order and sorts each one's members by Gray
rank, so the index is never in one place.

A task reads its nodes as one sorted list and factors it from below: eight neighbours share a pattern
(the bits in which they all agree), eight such groups another one, and so on. Comparison goes down from
the upper patterns and adds up the differences in the bits that each level fixes; a pair of groups is
pruned with all that is below it once its sum exceeds the limit, or if it has no node in common. Each
task hands on a spanning forest of its links, so what leaves it grows with its members, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .sieve import Filter, dealt_join
from .storage import settle
from .textbatch import bounded_batches, chunks, pick

#: Fixed values of the fingerprint: the seed and the words in a shingle. Words are parted by ASCII white space.
SEED = 42
SHINGLE = 3
#: Shingles hashed at a time.
_BLOCK = 1 << 14
#: Members above which a node is split once more.
NODE_LIMIT = 4096
#: Neighbours in Gray order that share a pattern, and pairs of groups that are expanded at a time.
FAN = 8
_PAIRS = 1 << 16
#: Members of whole nodes that a task compares at a time.
_ROWS = 1 << 14


def gray_rank(x: Column) -> Column:
    """The position of a bit pattern in the reflected Gray code: the exclusive or of all its right shifts."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one text in UTF-8; no words give zero."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - SHINGLE + 1)
    begin, end = starts[:n].tolist(), ends[-n:].tolist()
    view, hashed = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _BLOCK):
        values = np.array([hashed(view[a:b], SEED) for a, b in zip(begin[lo : lo + _BLOCK], end[lo : lo + _BLOCK])], dtype=np.uint64)
        bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long. Null and empty texts have fingerprint zero."""
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(chunk.text(row)) for chunk in chunks(batch) for row in range(chunk.hi - chunk.lo)]
            yield pa.record_batch([batch.column("id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


@dataclass
class GrayTree:
    """Patterns over fingerprints in Gray order: level 0 is the fingerprints, FAN neighbours are one group of the next.

    For every group: the bits that all its members have, those that none has, and its first and last
    node. ``visited`` counts pairs of groups that were compared, ``pruned`` those that ended there.
    """

    ones: list[np.ndarray]
    zeros: list[np.ndarray]
    first: list[np.ndarray]
    last: list[np.ndarray]
    visited: int = 0
    pruned: int = 0

    @classmethod
    def of(cls, members: np.ndarray, nodes: np.ndarray) -> "GrayTree":
        tree = cls([members], [~members], [nodes], [nodes])
        while len(tree.ones[-1]) > FAN:
            cuts = np.arange(0, len(tree.ones[-1]), FAN)
            tree.ones.append(np.bitwise_and.reduceat(tree.ones[-1], cuts))
            tree.zeros.append(np.bitwise_and.reduceat(tree.zeros[-1], cuts))
            tree.first.append(tree.first[-1][cuts])
            tree.last.append(np.maximum.reduceat(tree.last[-1], cuts))
        return tree

    def near(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of members of one node that differ in at most ``limit`` bits."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        a, b = np.triu_indices(len(self.ones[-1]))
        todo = [(len(self.ones) - 1, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64))]
        while todo:
            level, a, b, differ, seen = todo.pop()
            if len(a) > _PAIRS:
                todo += [(level, a[lo : lo + _PAIRS], b[lo : lo + _PAIRS], differ[lo : lo + _PAIRS], seen[lo : lo + _PAIRS]) for lo in range(0, len(a), _PAIRS)]
                continue
            ones, zeros = self.ones[level], self.zeros[level]
            fixed = (ones[a] | zeros[a]) & (ones[b] | zeros[b])
            # Only bits that no upper level had fixed in both groups are new; their differences are added.
            differ = differ + np.bitwise_count((ones[a] ^ ones[b]) & fixed & ~seen)
            stays = np.flatnonzero((differ <= limit) & (self.last[level][a] >= self.first[level][b]))
            self.visited += len(a)
            self.pruned += len(a) - len(stays)
            a, b, differ, seen = a[stays], b[stays], differ[stays], fixed[stays]
            if level == 0:
                found.append((a[a < b], b[a < b]))
            elif len(a):
                todo.append((level - 1, *self._below(level - 1, a, b, differ, seen)))
        return tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, differ: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pairs of the groups' parts, each once."""
        i, j = (side.ravel() for side in np.mgrid[:FAN, :FAN])
        own = np.repeat(np.arange(len(a)), FAN * FAN)
        a, b = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
        n = len(self.ones[level])
        real = (a < n) & (b < n) & (a <= b)
        return a[real], b[real], differ[own[real]], seen[own[real]]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices is linked to, over the given links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(limit: int):
    """Rows (mask, node, fp) in the index's order in, links (a, b) out; a node may cross batches."""

    def of_nodes(nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        members = fps.view(np.uint64)
        a, b = GrayTree.of(members, nodes).near(limit)
        if len(a):
            root = _forest(len(members), a, b)
            child = np.flatnonzero(root != np.arange(len(members)))
            yield pa.record_batch([pa.array(fps[child]), pa.array(fps[root[child]])], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("mask", "node", "fp")))
            if sum(len(x[0]) for x in held) >= _ROWS:
                mask, node, fps = (np.concatenate(x) for x in zip(*held))
                number = np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (node[1:] != node[:-1]))))
                cut = int(np.searchsorted(number, number[-1]))
                yield from of_nodes(number[:cut], fps[:cut]) if cut else ()
                held = [(mask[cut:], node[cut:], fps[cut:])]
        if held:
            mask, node, fps = (np.concatenate(x) for x in zip(*held))
            yield from of_nodes(np.cumsum(np.concatenate(([0], (mask[1:] != mask[:-1]) | (node[1:] != node[:-1])))), fps) if len(fps) else ()

    return links


def _masks(free: tuple[int, ...]) -> list[tuple[int, tuple[int, ...]]]:
    """The children of a node with these free bits: the bits each fixes, as a mask, and those left free."""
    cuts = [len(free) * k // 3 for k in range(4)]
    blocks = [free[a:b] for a, b in zip(cuts, cuts[1:])]
    return [(sum(1 << bit for bit in block), tuple(bit for bit in free if bit not in block)) for block in blocks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_fingerprints(prints: DataFrame, limit: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect whatever differs in at most ``limit`` (up to 2) bits."""
    if not 0 <= limit <= 2:
        raise ValueError("one of three blocks agrees only if at most two bits differ")
    links = None
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    tops: dict[int, tuple[int, ...]] = {0: tuple(range(64))}
    while True:
        children = {parent: _masks(free) for parent, free in tops.items()}
        table = F.create_map(*[x for parent, kids in children.items() for x in (F.lit(_signed(parent)), F.array(*[F.lit(_signed(parent | m)) for m, _ in kids]))])
        rows = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask")).select("fp", "mask", gray_rank(F.col("mask").bitwiseAND(F.col("fp"))).alias("node"))
        if len(tops) > 1:
            rows = rows.distinct()
        tops = {parent | m: free for parent, kids in children.items() for m, free in kids}
        # A node's free bits bound its members.
        last = max(len(free) for free in tops.values()) <= NODE_LIMIT.bit_length() - 1
        large = None
        if not last:
            rows = settle(rows, "nodes")
            large = settle(rows.groupBy("mask", "node").agg(F.count("*").alias("n")).where(F.col("n") > NODE_LIMIT).select("mask", "node"), "large-nodes")
            last = large.isEmpty()
        small = rows if last else rows.join(large, ["mask", "node"], "left_anti")
        rank = gray_rank(F.col("fp"))
        found = small.select("mask", "node", "fp").repartitionByRange("mask", "node").sortWithinPartitions("mask", "node", rank).mapInArrow(_links(limit), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        rows = rows.join(large, ["mask", "node"], "left_semi").select("fp", "mask")


def _grouped(docs: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """(id, fp, component_id, root) of every row; root is the smallest fingerprint of the component."""
    prints = settle(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(similar_fingerprints(distinct.select("fp"), limit))
    held = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    held = settle(held, "rooted")
    smallest = held.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = settle(held.join(smallest, "root").select("fp", "component_id", "root", "n"), "component-of-fingerprint")
    return dealt_join(prints, of_print, "fp", F.col("id")).select("id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 2) -> DataFrame:
    """Near-duplicate components of documents by SimHash.

    Returns one row for each input row: id, fp (signed long), component_id, the smallest id that is
    reachable over fingerprints at ``limit`` or fewer differing bits. Null and empty texts have
    fingerprint zero and link like any other. Equal texts share a fingerprint. A null id counts in
    no minimum; a component of null ids only has a null component_id. An empty table gives no rows.
    Other columns of ``docs`` are ignored.
    """
    return _grouped(docs, doc_id, text, limit).select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 2) -> DataFrame:
    """One document of each component, in its own columns: the one with the smallest identifier.

    A row goes by its identifier and fingerprint together, so rows that share an identifier but not
    a component are judged apart. Of repeated rows with one identifier and one fingerprint one stays,
    and of a component of null identifiers one with the smallest fingerprint. Rows to go, and rows of
    which there are several, are a filter first: the texts of other rows don't move.
    """
    stays = F.when(F.col("component_id").isNull(), F.col("fp") == F.col("root")).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    found = _grouped(docs, doc_id, text, limit).groupBy("id", "fp").agg(F.max(stays).alias("stays"), F.count("*").alias("copies"))
    seen = Observation()
    odd = found.where("NOT stays OR copies > 1").observe(seen, F.count("*").alias("n"))
    odd = settle(odd.select(F.col("id").alias("__id"), F.col("fp").alias("__odd"), F.col("stays").alias("__stays")), "dropped-or-repeated")
    near = Filter.of(odd, seen.get["n"], "__id").admits(docs, docs[doc_id])
    sure = near.where("NOT __maybe").drop("__maybe")
    doubted = _with_fingerprint(near.where("__maybe").drop("__maybe"), text)
    # What is odd has no size bound, so it isn't broadcast however few rows it is here.
    judged = doubted.join(odd.hint("merge"), F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__odd")), "left")
    rest = judged.where("__stays IS NULL OR __stays").dropDuplicates([doc_id, "__fp"])
    return sure.unionByName(rest.select(*docs.columns))


def _with_fingerprint(docs: DataFrame, text: str) -> DataFrame:
    """The rows with a column __fp."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(chunk.text(row)) for chunk in chunks(pa.record_batch([batch.column(at)], names=["text"])) for row in range(chunk.hi - chunk.lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=[*batch.schema.names, "__fp"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))
