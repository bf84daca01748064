"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are kept: of every run of consecutive word grams, the position of the
gram with the smallest hash. A passage of LENGTH words or more contains a minimiser at the same place
in all its copies, so comparing these suffixes finds every repeat. Suffixes whose first gram occurs
once are dropped after a count; the others are sorted as suffixes, word by word, and the common
length of neighbours is measured. Suffixes with enough words in common are one stretch of the sorted
order; there the match is extended to the left, word by word, and it counts where left and right come
to LENGTH together. Around one minimiser no more than REACH words on either side can matter: every
passage beyond that has further minimisers, whose matches overlap. A word is repeated if it is inside
LENGTH consecutive words that two documents have, and this finds exactly those words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .sieve import Filter, dealt_join
from .storage import settle
from .textbatch import Chunk, ascii_lower, bounded_batches, byte_class, chunks, mix, pick, span_hash, spans

#: Words of the shortest passage that counts, and of the gram that a minimiser begins.
LENGTH = 50
GRAM = 16
#: Words of context on either side of a gram that a passage may reach into.
REACH = LENGTH - GRAM
#: Suffixes that may meet by one gram in one task; grams with more are split by all their contexts instead.
LIMIT = 2_000

_WORD = ~byte_class((9, 13), (32, 32))
_LOWER = ascii_lower()


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of a chunk and the offsets of its rows' words."""
    starts, ends, rows = spans(chunk, _WORD)
    counts = np.bincount(rows, minlength=chunk.hi - chunk.lo)
    return span_hash(_LOWER[chunk.data], starts, ends), np.concatenate(([0], np.cumsum(counts)))


def minimisers(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes (word indices in the chunk) and the hashes of their grams.

    For each run of REACH + 1 grams of one text the smallest gram, the leftmost of equal ones.
    """
    n = len(words)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(words, at, at + GRAM)
    width = REACH + 1
    # The smallest of any `width` neighbours, by doubling: of 1, 2, 4, ... and then two overlapping halves.
    low, best, size = grams, at, 1
    while size * 2 <= width:
        low, best = _least(low[:-size], best[:-size], low[size:], best[size:])
        size *= 2
    if size < width:
        rest = width - size
        low, best = _least(low[:-rest], best[:-rest], low[rest:], best[rest:])
    row = np.searchsorted(offsets, np.arange(len(best)), side="right") - 1
    inside = np.arange(len(best)) + LENGTH <= offsets[row + 1]
    kept = np.unique(best[inside])
    return kept, grams[kept]


def _least(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = a <= b
    return np.where(first, a, b), np.where(first, at_a, at_b)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_words, print, grams) of every row: the hash of all its words and those of its minimisers' grams."""
    for batch in batches:
        counts, prints, grams = [np.zeros(0, np.int64)], [], []
        for chunk in chunks(batch):
            words, offsets = word_hashes(chunk)
            at, hashes = minimisers(words, offsets)
            counts.append(np.diff(offsets))
            cuts = np.searchsorted(at, offsets)
            for k in range(chunk.hi - chunk.lo):
                prints.append(xxhash.xxh3_128_digest(words[offsets[k] : offsets[k + 1]].tobytes()))
                grams.append(np.unique(hashes[cuts[k] : cuts[k + 1]]).view(np.int64))
        yield pa.record_batch([batch.column("id"), pa.array(np.concatenate(counts)), pa.array(prints, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=["id", "n_words", "print", "grams"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, id, places, before, after): wanted suffixes with up to REACH words on either side of their grams.

    The suffixes of one text that agree in all this are one row with several places, so a word that
    is repeated thousands of times is a few rows. ``before`` is read leftwards.
    """
    for batch in batches:
        ids, wanted, done = batch.column("id").to_numpy(), batch.column("wanted"), 0
        for chunk in chunks(batch):
            words, offsets = word_hashes(chunk)
            at, grams = minimisers(words, offsets)
            row = np.searchsorted(offsets, at, side="right") - 1
            cuts = np.searchsorted(row, np.arange(chunk.hi - chunk.lo + 1))
            keep = np.zeros(len(at), dtype=bool)
            for k in range(chunk.hi - chunk.lo):
                keep[cuts[k] : cuts[k + 1]] = np.isin(grams[cuts[k] : cuts[k + 1]].view(np.int64), np.asarray(wanted[done + k].values))
            at, grams, row = at[keep], grams[keep], row[keep]
            if len(at):
                yield _context_rows(words, offsets, at, grams, row, ids[done:])
            done += chunk.hi - chunk.lo


def _context_rows(words: np.ndarray, offsets: np.ndarray, at: np.ndarray, grams: np.ndarray, row: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    # High bytes first, so that bytes sort as the words' hashes do.
    ordered = words.astype(">u8")
    n_before, n_after = np.minimum(at - offsets[row], REACH), np.minimum(offsets[row + 1] - at - GRAM, REACH)
    whole = span_hash(words, at - n_before, at + GRAM + n_after)
    key = mix(whole + (n_before * 64 + n_after).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    first = order[cuts]
    local = (at - offsets[row]).astype(np.int32)
    before = [ordered[a - n : a][::-1].tobytes() for a, n in zip(at[first].tolist(), n_before[first].tolist())]
    after = [ordered[a : a + n].tobytes() for a, n in zip((at[first] + GRAM).tolist(), n_after[first].tolist())]
    places = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(order)).astype(np.int32)), pa.array(local[order]))
    return pa.record_batch([pa.array(grams[first].view(np.int64)), pa.array(ids[row[first]]), places, pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["gram", "id", "places", "before", "after"])


def _side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a side in rows of REACH, and how many words each side has."""
    size = np.asarray(pa.compute.binary_length(column)) // 8
    words = np.zeros((len(column), REACH), dtype=np.uint64)
    words[np.arange(REACH) < size[:, None]] = np.frombuffer(b"".join(column.to_pylist()), dtype=">u8")
    return words, size


def _running(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... REACH words of every row."""
    out = np.zeros((len(words), REACH + 1), dtype=np.uint64)
    for j in range(REACH):
        out[:, j + 1] = mix(out[:, j] * np.uint64(0x9E3779B97F4A7C15) + words[:, j] + np.uint64(1))
    return out


def _common(words: np.ndarray, size: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each suffix in sorted order, the words after the gram that it has in common with the one before; -1 for another gram."""
    out = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        differ = words[1:] != words[:-1]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), REACH)
        out[1:] = np.where(grams[1:] == grams[:-1], np.minimum(length, np.minimum(size[1:], size[:-1])), -1)
    return out


def _spans_of(rows: pa.Table) -> pa.RecordBatch | None:
    """(id, start, stop, first_id) of what sorted suffixes share with suffixes of other documents."""
    ids, grams = rows.column("id").to_numpy(), rows.column("gram").to_numpy()
    common = _common(*_side(rows.column("after").combine_chunks()), grams)
    # A suffix that differs from both neighbours right after its gram can only match to the left.
    words, n_left = _side(rows.column("before").combine_chunks())
    left = _running(words)
    least, most, first = np.full(len(ids), REACH + 1), np.full(len(ids), -1), ids.copy()
    for o in range(REACH + 1):
        starts = common < REACH - o
        stretch = np.cumsum(starts)
        met = ~starts
        met[:-1] |= ~starts[1:]
        some = np.flatnonzero(met & (n_left >= o))
        if len(some) < 2:
            continue
        hashes = mix(left[some, o] + stretch[some].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        order = np.argsort(hashes, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
        sorted_ids = ids[some][order]
        low, high = np.minimum.reduceat(sorted_ids, cuts), np.maximum.reduceat(sorted_ids, cuts)
        sizes = np.diff(np.append(cuts, len(order)))
        shared = np.repeat(low != high, sizes)
        hit = some[order[shared]]
        least[hit] = np.minimum(least[hit], o)
        most[hit] = o
        first[hit] = np.minimum(first[hit], np.repeat(low, sizes)[shared])
    hit = np.flatnonzero(most >= 0)
    if not len(hit):
        return None
    places = rows.column("places").combine_chunks()
    counts = np.asarray(pa.compute.list_value_length(places))[hit]
    at = np.asarray(pa.compute.list_flatten(places.take(pa.array(hit))))
    own = np.repeat(hit, counts)
    return _merged(ids[own], at - most[own], at + LENGTH - least[own], first[own])


def _merged(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Overlapping spans of one document with one first document as one span."""
    order = np.lexsort((start, first, ids))
    ids, start, stop, first = ids[order], start[order], stop[order], first[order]
    new = np.ones(len(ids), dtype=bool)
    # All spans of a document and first are sorted by start; their stops reach LENGTH on, so neighbours decide.
    new[1:] = (ids[1:] != ids[:-1]) | (first[1:] != first[:-1]) | (start[1:] > stop[:-1])
    cuts = np.flatnonzero(new)
    return pa.record_batch([pa.array(ids[cuts]), pa.array(start[cuts].astype(np.int64)), pa.array(np.maximum.reduceat(stop, cuts).astype(np.int64)), pa.array(first[cuts])], names=["id", "start", "stop", "first_id"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in sorted order in, spans out. A gram's suffixes may cross batches; at most LIMIT of them meet."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        grams = batch.column("gram").to_numpy()
        if n >= _BLOCK and grams[0] != grams[-1]:
            cut = int(np.searchsorted(grams, grams[-1]))
            made = _spans_of(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, n = [batch.slice(cut)], batch.num_rows - cut
            if made is not None:
                yield made
    if n:
        made = _spans_of(pa.Table.from_batches(held))
        if made is not None:
            yield made


#: Rows of complete grams that are compared at a time.
_BLOCK = 4096


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, id, start, stop) for every way in which LENGTH words lie around a suffix's gram; window is their hash."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        (words, n_right), (before, n_left) = _side(batch.column("after")), _side(batch.column("before"))
        right, left, grams = _running(words), _running(before), mix(batch.column("gram").to_numpy().view(np.uint64))
        for o in range(REACH + 1):
            some = np.flatnonzero((n_left >= o) & (n_right >= REACH - o))
            hashes = mix(grams[some] + mix(left[some, o] + np.uint64(o + 1)) + np.uint64(3) * mix(right[some, REACH - o]))
            places = rows.column("places").combine_chunks().take(pa.array(some))
            own = np.repeat(np.arange(len(some)), np.asarray(pa.compute.list_value_length(places)))
            at = np.asarray(pa.compute.list_flatten(places)).astype(np.int64)
            yield pa.record_batch([pa.array(hashes[own].view(np.int64)), pa.array(rows.column("id").to_numpy()[some][own]), pa.array(at - o), pa.array(at - o + LENGTH)], names=["window", "id", "start", "stop"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Passages of LENGTH or more words that occur in two or more documents.

    Words are parted by ASCII white space and compared without ASCII case. Returns one row for each
    maximal run of repeated words: id, start, stop (word positions, stop exclusive), n_words,
    first_id (the smallest id of a document that has some of the run). Identifiers are integers; rows
    with a null id are left out, and rows that share an id are one document, whose repeats with
    itself don't count. Null, empty and short texts have no passages. Copies of a whole text are
    matched by a hash of all their words, so only one of them is searched. No table of documents,
    or one without repeats, gives no rows. Other columns are ignored.

    Suffixes of grams that more than ``limit`` documents share never meet in one task: they are split
    by every window of LENGTH words around the gram, and windows are counted in sums that start before
    the shuffle. The result is the same at any limit.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long")).where("id IS NOT NULL")
    sampled = settle(rows.mapInArrow(_sampled, "id long, n_words long, print binary, grams array<bigint>"), "suffixes")
    # Texts shorter than a passage have no suffixes. Only texts of which there may be copies are dealt by their hashes.
    sampled = sampled.where(F.col("n_words") >= LENGTH)
    seen = Observation()
    same = sampled.groupBy("print").agg(F.min("id").alias("first_id"), F.max("id").alias("high"), F.count("*").alias("n")).where("first_id <> high").select("print", "first_id", "n")
    same = settle(same.observe(seen, F.count("*").alias("n")), "copied-texts")
    sampled = Filter.of(same, seen.get["n"], "print").admits(sampled, F.col("print"))
    met = dealt_join(sampled.where("__maybe").drop("__maybe"), same, "print", F.col("id"), "left")
    whole = met.where("first_id IS NOT NULL").select("id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"), "first_id")
    searched = sampled.where("NOT __maybe").select("id", "grams").unionByName(met.where("first_id IS NULL OR id = first_id").select("id", "grams"))
    grams = settle(searched.select("id", F.explode("grams").alias("gram")), "grams")
    shared = grams.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> high").select("gram", (F.col("n") > limit).alias("hot"))
    shared = settle(shared, "shared-grams")
    wanted = settle(grams.join(shared, "gram").groupBy("id", "hot").agg(F.collect_set("gram").alias("wanted")), "wanted-suffixes")

    def contexts(hot: bool) -> DataFrame:
        of = wanted.where(F.col("hot") == hot).select("id", "wanted")
        return rows.join(of, "id").select("id", "text", "wanted").mapInArrow(_contexts, "gram long, id long, places array<int>, before binary, after binary")

    columns = "id long, start long, stop long, first_id long"
    found = contexts(False).repartition("gram").sortWithinPartitions("gram", "after").mapInArrow(_met, columns)
    if not shared.where("hot").isEmpty():
        windows = settle(contexts(True).mapInArrow(_counted, "window long, id long, start long, stop long"), "hot-windows")
        twice = windows.groupBy("window").agg(F.min("id").alias("first_id"), F.max("id").alias("high"), F.count("*").alias("n")).where("first_id <> high")
        twice = settle(twice.select("window", "first_id", "n"), "shared-windows")
        found = found.unionByName(dealt_join(windows, twice, "window", F.col("id")).select("id", "start", "stop", "first_id"))
    found = settle(found, "shared-spans")
    # A copy shares with others whatever the copy that was searched shares with them.
    best = found.groupBy(F.col("id").alias("first_id")).agg(F.min("first_id").alias("best"))
    whole = whole.join(best, "first_id", "left").select("id", "start", "stop", F.least("first_id", "best").alias("first_id"))
    return _islands(found.unionByName(whole))


def _islands(found: DataFrame) -> DataFrame:
    """Unite the overlapping or touching spans of each document; a document's spans are as many as its words at most."""
    order = Window.partitionBy("id").orderBy("start", "stop")
    so_far = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("so_far"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = found.withColumn("so_far", so_far).withColumn("island", island)
    merged = runs.groupBy("id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_id").alias("first_id"))
    return merged.select("id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "first_id")
