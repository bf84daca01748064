"""Repeated word windows by prefix-partitioned suffix trees.

A suffix begins at every word that ``window`` words of its text can be read from. Suffixes are split
into groups by a prefix of variable length: the first words of a suffix, and more of them where so
many suffixes begin alike that a group would outgrow its share. All suffixes of a group are a subtree
of the suffix tree, and no other suffix belongs to it. A task reads its subtrees in the order of
their leaves, with Spark's sort and what neighbours have in common, so only the path to the leaf at
hand is ever in memory. An internal node at a depth of ``window`` words is a repeat: its leaves, in
the order of places, are the places where these words stand, and all but the first are later ones.

Two scans come before the subtrees. Of every window the 8 words with the smallest hash are counted;
equal windows have the same, so a window whose words are counted once is a leaf of its own and never
leaves its task. The same scan counts prefixes that many suffixes of a chunk share, which gives the
lengths of the prefixes. Equal windows of one chunk of texts are settled there, and one of them is a
suffix of the tree, so that no words are hot however often they stand in the corpus.

Words are compared by hashes: two windows are equal if the hashes of their first, middle and last
words are, 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .sieve import BITS_A_KEY, CELL, MOST_BITS, Filter, dealt_join
from .storage import settle
from .textbatch import Chunk, bounded_batches, byte_class, chunks, mix, pick, span_hash, spans

#: Words of a window.
WINDOW = 20
#: A prefix that more than one in so many suffixes have is too short; so many prefixes at most are longer.
SHARE = 4096
#: Suffixes that a prefix may have in any case, and the suffixes of a chunk that must have it to be counted.
LEAST = 1 << 16
OFTEN = 8

_WORD = ~byte_class((9, 13), (32, 32))


@dataclass(frozen=True)
class Shape:
    """Where the letters of a suffix end: it is read as three of them, of about 2, 1.5 and 1.5 fifths of a window."""

    window: int

    @property
    def cuts(self) -> tuple[int, int, int]:
        first = max(1, self.window * 2 // 5)
        return first, (first + self.window) // 2, self.window

    @property
    def gram(self) -> int:
        return self.cuts[0]


def read_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, their starts and ends in its bytes, and the offsets of its rows' words."""
    starts, ends, rows = spans(chunk, _WORD)
    counts = np.bincount(rows, minlength=chunk.hi - chunk.lo)
    return span_hash(chunk.data, starts, ends), starts, ends, np.concatenate(([0], np.cumsum(counts)))


def suffixes_of(offsets: np.ndarray, window: int) -> np.ndarray:
    """Word positions that a whole window can be read from."""
    at = np.arange(max(offsets[-1] - window + 1, 0))
    row = np.searchsorted(offsets, at, side="right") - 1
    return at[at + window <= offsets[row + 1]]


def rarest(words: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``words``, the position and the hash of its gram with the smallest hash, leftmost of equal ones."""
    at = np.arange(len(words) - shape.gram + 1)
    low = span_hash(words, at, at + shape.gram)
    width, size = shape.window - shape.gram + 1, 1
    while size < width:
        step = min(size, width - size)
        first = low[:-step] <= low[step:]
        low, at = np.where(first, low[:-step], low[step:]), np.where(first, at[:-step], at[step:])
        size += step
    return at, low


def letters(words: np.ndarray, at: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """The letters of the suffixes ``at``, as hashes of their words."""
    ends = (0, *shape.cuts)
    return [span_hash(words, at + a, at + b) if b > a else np.zeros(len(at), np.uint64) for a, b in zip(ends, ends[1:])]


def _prefixes(found: list[np.ndarray]) -> list[np.ndarray]:
    """The suffixes' prefixes of one letter and of two."""
    return [found[0], mix(found[0] + np.uint64(0x9E3779B97F4A7C15) * found[1])]


def _counted(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(kind, hash, n): grams that are a window's smallest (kind 0), and prefixes of one letter or two that are frequent in a chunk (1, 2)."""
        for batch in batches:
            for chunk in chunks(batch):
                words, _, _, offsets = read_words(chunk)
                own = suffixes_of(offsets, shape.window)
                if not len(own):
                    continue
                at, low = rarest(words, shape)
                # Overlapping windows have a gram in common, which is counted once for its place.
                places = np.unique(at[own], return_index=True)[1]
                kinds = [(0, *np.unique(low[own][places], return_counts=True))]
                for kind, prefix in enumerate(_prefixes(letters(words, own, shape)), 1):
                    key, n = np.unique(prefix, return_counts=True)
                    kinds.append((kind, key[n >= OFTEN], n[n >= OFTEN]))
                kind = np.concatenate([np.full(len(key), k, np.int8) for k, key, _ in kinds])
                yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([key for _, key, _ in kinds]).view(np.int64)), pa.array(np.concatenate([n for _, _, n in kinds]))], names=["kind", "hash", "n"])

    return run


@dataclass(frozen=True)
class Plan:
    """What the first scan found: a bitmap over grams that occur twice, and sorted prefixes of one letter and two that are too short."""

    seen: np.ndarray
    short: tuple[np.ndarray, np.ndarray]

    def repeated(self, grams: np.ndarray) -> np.ndarray:
        """False only for grams that occur once."""
        bit = grams & np.uint64(len(self.seen) * 8 - 1)
        return (self.seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def lengths(self, found: list[np.ndarray]) -> np.ndarray:
        """How many letters the prefix of each suffix has."""
        out = np.ones(len(found[0]), dtype=np.int8)
        for length, (prefix, short) in enumerate(zip(_prefixes(found), self.short), 1):
            out[(out == length) & np.isin(prefix, short)] = length + 1
        return out


def plan(rows: DataFrame, shape: Shape, share: int = SHARE, least: int = LEAST) -> Plan:
    """The bitmap has 128 MB at most and a list of prefixes ``share`` entries, so both may go to every task."""
    seen = Observation()
    counts = rows.mapInArrow(_counted(shape), "kind byte, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n"))
    counts = counts.observe(seen, F.count_if((F.col("kind") == 0) & (F.col("n") > 1)).alias("grams"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("places"))
    counts = settle(counts.where("kind > 0 OR n > 1"), "gram-counts")
    grams, places = seen.get["grams"], seen.get["places"] or 0
    bits = max(CELL, min(MOST_BITS, 1 << (BITS_A_KEY * grams).bit_length()))
    at = F.pmod("hash", F.lit(bits))
    cells = counts.where("kind = 0").groupBy(F.floor(at / CELL).cast("int").alias("cell")).agg(F.bitmap_construct_agg(at % CELL).alias("bitmap"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for cell in cells.toLocalIterator():
        bitmap[cell["cell"] * CELL // 8 :][: CELL // 8] = np.frombuffer(cell["bitmap"], dtype=np.uint8)
    # The place of a gram is that of so many windows at most, and a suffix has one prefix of a length: no more than ``share`` prefixes of it pass.
    often = counts.where((F.col("kind") > 0) & (F.col("n") > max(least, places * (shape.window - shape.gram + 1) // share)))
    short: dict[int, list[int]] = {1: [], 2: []}
    for prefix in often.select("kind", "hash").collect():
        short[prefix["kind"]].append(prefix["hash"])
    return Plan(bitmap, tuple(np.sort(np.array(short[k], dtype=np.int64)).view(np.uint64) for k in (1, 2)))


_SUFFIX = "letters byte, a long, b long, c long, id long, start int, text_print int"


def _suffixes(shape: Shape, known: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first suffix of every window that may be repeated, and (with 0 letters) what is later than it in the chunk."""
        for batch in batches:
            ids = batch.column("id").to_numpy()
            prints = batch.column("text_print").to_numpy()
            for chunk in chunks(batch):
                words, _, _, offsets = read_words(chunk)
                at = suffixes_of(offsets, shape.window)
                if len(at):
                    at = at[known.value.repeated(rarest(words, shape)[1][at])]
                if not len(at):
                    continue
                row = np.searchsorted(offsets, at, side="right") - 1
                found = letters(words, at, shape)
                own, start = ids[chunk.lo + row], at - offsets[row]
                print_of = prints[chunk.lo + row]
                order = np.lexsort((print_of, start, own, *found[::-1]))
                found, own, start, print_of = [x[order] for x in found], own[order], start[order], print_of[order]
                first = first_of(found, None)
                head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
                size = known.value.lengths(found)
                size[(own != own[head]) | (start != start[head])] = 0
                # Repeated rows are one leaf.
                once = np.ones(len(own), dtype=bool)
                once[1:] = first[1:] | (own[1:] != own[:-1]) | (start[1:] != start[:-1]) | (print_of[1:] != print_of[:-1])
                columns = [pa.array(size[once]), *[pa.array(x[once].view(np.int64)) for x in found], pa.array(own[once]), pa.array(start[once].astype(np.int32)), pa.array(print_of[once])]
                yield pa.record_batch(columns, names=["letters", "a", "b", "c", "id", "start", "text_print"])

    return run


def common(found: list[np.ndarray], last: list[np.ndarray] | None) -> np.ndarray:
    """How many letters every suffix in the order of leaves has in common with the one before it, which for the first is ``last``."""
    same = np.ones(len(found[0]), dtype=bool)
    depth = np.zeros(len(found[0]), dtype=np.int8)
    for k, letter in enumerate(found):
        same[1:] &= letter[1:] == letter[:-1]
        same[0] = bool(same[0]) and last is not None and bool(letter[0] == last[k])
        depth += same
    return depth


def first_of(found: list[np.ndarray], last: list[np.ndarray] | None) -> np.ndarray:
    """Whether a leaf is the first below its node at the depth of a window."""
    return common(found, last) < len(found)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves in order in, all that stand later than the first leaf of their deep node out."""
    last, head_id, head_start = None, 0, 0
    for batch in batches:
        letters_read = batch.column("letters").to_numpy()
        settled = np.flatnonzero(letters_read == 0)
        leaves = np.flatnonzero(letters_read > 0)
        names = ["id", "start", "text_print"]
        if len(settled):
            yield batch.select(names).take(pa.array(settled))
        if not len(leaves):
            continue
        own = batch.take(pa.array(leaves))
        found = [own.column(name).to_numpy() for name in "abc"]
        ids, start = own.column("id").to_numpy(), own.column("start").to_numpy()
        first = first_of(found, last)
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        node_id = np.where(head >= 0, ids[np.maximum(head, 0)], head_id)
        node_start = np.where(head >= 0, start[np.maximum(head, 0)], head_start)
        later = np.flatnonzero((ids != node_id) | (start != node_start))
        last, head_id, head_start = [x[-1] for x in found], node_id[-1], node_start[-1]
        if len(later):
            yield own.select(names).take(pa.array(later))


def later_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """(id, start, text_print) of every window whose words also start earlier: in a document with a smaller id, or before it in the same one.

    Identifiers are integers. A null id is no place: its windows are in no row and make no others
    later. ``text_print`` is 32 bits of the text, which tell rows that share an identifier.
    """
    bounded_batches(docs.sparkSession)
    shape = Shape(window)
    rows = pick(docs, id=doc_id, text=text).where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("text_print"))
    known = docs.sparkSession.sparkContext.broadcast(plan(rows, shape, share, least))
    found = rows.mapInArrow(_suffixes(shape, known), _SUFFIX)
    # What is settled has no subtree, and is dealt by its place.
    prefix = F.when(F.col("letters") == 0, F.xxhash64("id", "start")).when(F.col("letters") == 1, F.xxhash64("a")).when(F.col("letters") == 2, F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c"))
    grouped = found.repartition(prefix).sortWithinPartitions("a", "b", "c", "id", "start")
    return grouped.mapInArrow(_later, "id long, start int, text_print int")


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, n_words, n_removed, spans, kept): the words that no later window covers, joined by spaces."""
        for batch in batches:
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            later = batch.column("later")
            per_row = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(later), 0))
            begins, upto = np.asarray(pa.compute.list_flatten(later)), np.concatenate(([0], np.cumsum(per_row)))
            n_words, n_removed, spans_of, kept = [], [], [], []
            for chunk in chunks(batch):
                _, starts, ends, offsets = read_words(chunk)
                rows = np.arange(chunk.lo, chunk.hi)
                at = np.repeat(offsets[:-1], per_row[rows]) + begins[upto[chunk.lo] : upto[chunk.hi]]
                copied = suffixes_of(offsets, window)
                copied = copied[whole[chunk.lo + np.searchsorted(offsets, copied, side="right") - 1]]
                cover = np.bincount(np.concatenate((at, copied)), minlength=len(starts) + 1) - np.bincount(np.concatenate((at, copied)) + window, minlength=len(starts) + 1)
                gone = np.cumsum(cover)[: len(starts)] > 0
                removed = np.concatenate(([0], np.cumsum(gone)))
                n_words.append(np.diff(offsets))
                n_removed.append(np.diff(removed[offsets]))
                spans_of += [_runs(gone[a:b]) if n else [] for a, b, n in zip(offsets[:-1], offsets[1:], n_removed[-1])]
                kept += _joined(chunk, starts[~gone], ends[~gone], np.diff(offsets) - n_removed[-1])
            columns = [batch.column("id"), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(spans_of, pa.list_(pa.int64())), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=["id", "n_words", "n_removed", "spans", "kept"])

    return run


def _runs(gone: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))).tolist()


def _joined(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The given words of each row, joined by one space; a word but a row's last has a byte after it, which becomes the space."""
    last = np.cumsum(counts)[counts > 0] - 1
    spaces = np.delete(ends, last)
    edge = np.zeros(len(chunk.data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    take = np.cumsum(edge, dtype=np.int8)[:-1].astype(bool)
    take[spaces] = True
    data = chunk.data.copy()
    data[spaces] = 32
    cuts = np.concatenate(([0], np.cumsum(take)))[chunk.offsets]
    whole = data[take].tobytes()
    return [whole[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """Remove every word that is inside ``window`` consecutive words which also start earlier.

    Words are parted by ASCII white space and compared as they are. Earlier is a smaller document id,
    or the same document and an earlier start; windows are judged on the texts as given. Returns one
    row for each input row: id, n_words, n_removed, spans (starts and ends of maximal runs of removed
    words, ends exclusive), kept (the other words, joined by one space; null texts have an empty one).

    Null, empty and short texts lose nothing. Identifiers are integers, or strings of them. Of rows
    with the same id, a window at the same start is in the same place in each, so none of them is
    earlier. A row without an id keeps all its words and takes none from others. An empty table gives
    no rows. Other columns are ignored. Copies of a whole text are told by its SHA-256; each of their
    windows starts in the text with the smallest id too, so they lose all of them without being read.

    ``share`` and ``least`` set when prefixes get longer; they change no result.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text).select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("print"))
    seen = Observation()
    digests = rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", "print", F.unhex(F.sha2("text", 256)).alias("digest"))
    copied = digests.groupBy("digest").agg(F.min("print").alias("print"), F.min("id").alias("first_id"), F.max("id").alias("high"), F.count("*").alias("n")).where("first_id <> high")
    copied = settle(copied.select("digest", "print", "first_id", "n").observe(seen, F.count("*").alias("n")), "copied-texts")
    # Only texts of which there may be copies are dealt by their digests.
    flagged = Filter.of(copied, seen.get["n"], "print").admits(rows, F.col("print"))
    suspects = flagged.where("__maybe").select("id", "text", "print", F.unhex(F.sha2("text", 256)).alias("digest"))
    suspects = settle(dealt_join(suspects, copied.select("digest", "first_id", "n"), "digest", F.xxhash64("id"), "left").select("id", "text", "print", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("whole")), "texts-with-copies")
    others = flagged.where("NOT __maybe").select("id", "text", "print")
    searched = others.unionByName(suspects.where("NOT whole").drop("whole"))
    found = later_windows(searched, "id", "text", window, share, least)
    held = Observation()
    later = found.groupBy(F.col("id").alias("of"), "text_print").agg(F.collect_list("start").alias("later"))
    later = settle(later.observe(held, F.count("*").alias("n")), "later-windows")
    searched = searched.withColumn("text_print", F.shiftright("print", 32).cast("int"))
    flagged = Filter.of(later, held.get["n"], "of", "text_print").admits(searched, F.col("id"), F.col("text_print"))
    met = flagged.where("__maybe").join(later.withColumnRenamed("text_print", "own_print"), (F.col("id") == F.col("of")) & (F.col("text_print") == F.col("own_print")), "left")
    none, no, yes = F.lit(None).cast("array<int>").alias("later"), F.lit(False).alias("whole"), F.lit(True).alias("whole")
    every = met.select("id", "text", "later", no).unionByName(flagged.where("NOT __maybe").select("id", "text", none, no)).unionByName(suspects.where("whole").select("id", "text", none, yes))
    return every.mapInArrow(_kept(window), "id long, n_words long, n_removed long, spans array<bigint>, kept string")
