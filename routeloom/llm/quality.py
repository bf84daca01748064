"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are those of its own characters and words and the same
features of the line before and after. Lines learn from the label of their document; forward-
backward gives each line's probability of being good, and a document's quality is the mean of these,
weighted by the lengths of the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .labelled import fold, training_rows
from .textbatch import Chunk, ascii_lower, bounded_batches, byte_class, chunks, pick, span_hash, spans

#: Labelled rows used for fitting, at most.
SAMPLE = 6000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

#: Upper bounds of the buckets of each measure of a line.
MEASURES = {
    "length": (0, 20, 60, 120, 250, 600, 2000),
    "upper share": (0.001, 0.05, 0.1, 0.2, 0.5, 0.8),
    "sign share": (0.005, 0.02, 0.04, 0.08, 0.15, 0.3),
    "bars for a word": (0.01, 0.1, 0.3, 0.6),
    "exclamations for a word": (0.01, 0.1, 0.4, 0.8),
    "digit share": (0.001, 0.01, 0.05, 0.2),
    "letters for a word": (2, 3, 4, 5, 6, 8, 12),
    "distinct words": (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.99),
    "equal neighbours": (0.005, 0.03, 0.1, 0.3, 0.7),
    "copies of the line": (1.5, 2.5, 5.5, 20.5),
    "short words": (0.1, 0.25, 0.4, 0.55, 0.7),
    "stops for a word": (0.01, 0.03, 0.08, 0.15, 0.3),
}
_WIDTH = max(map(len, MEASURES.values())) + 1
#: Features of one line: its measures; then those of the line before and after, with one more for no such line.
N_FEATURES = 3 * len(MEASURES) * (_WIDTH + 1)

_LINE = ~byte_class((10, 10))
_WORD = ~byte_class((9, 13), (32, 32))
_UPPER, _LOWER, _DIGIT = byte_class((65, 90)), byte_class((97, 122), (128, 255)), byte_class((48, 57))
_SIGN = byte_class((33, 47), (58, 64), (91, 96), (123, 126)) & ~byte_class((44, 44), (46, 46))
_BAR, _CALL, _STOP = byte_class((124, 124)), byte_class((33, 33)), byte_class((44, 44), (46, 46), (63, 63))
_LOWERED = ascii_lower()


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x columns), lengths in bytes, and the offsets of documents' lines.

    Blank lines are skipped. A document without other lines has one line of length zero.
    """
    starts, ends, rows = spans(chunk, _LINE)
    n_docs = chunk.hi - chunk.lo
    word_starts, word_ends, _ = spans(chunk, _WORD)
    line_of = np.searchsorted(starts, word_starts, side="right") - 1
    words = np.bincount(line_of, minlength=len(starts))
    keep = words > 0
    starts, ends, rows, words = starts[keep], ends[keep], rows[keep], words[keep]
    line_of = (np.cumsum(keep) - 1)[line_of] if len(keep) else line_of
    n = len(starts)
    measures = np.zeros((n, len(MEASURES)))
    length = (ends - starts).astype(np.float64)
    if n:

        def count(member: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(member[chunk.data], dtype=np.int64)))
            return (sums[ends] - sums[starts]).astype(np.float64)

        upper, letters = count(_UPPER), count(_UPPER | _LOWER)
        hashes = span_hash(_LOWERED[chunk.data], word_starts, word_ends)
        order = np.lexsort((hashes, line_of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
        distinct = np.bincount(line_of[order], weights=new, minlength=n)
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
        whole = span_hash(chunk.data, starts, ends)
        _, inverse, copies = np.unique(whole + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        columns = (
            length,
            upper / np.maximum(letters, 1),
            count(_SIGN) / length,
            count(_BAR) / words,
            count(_CALL) / words,
            count(_DIGIT) / length,
            (letters + count(_DIGIT)) / words,
            distinct / words,
            np.bincount(line_of, weights=same, minlength=n) / words,
            copies[inverse],
            np.bincount(line_of, weights=(word_ends - word_starts) <= 3, minlength=n) / words,
            count(_STOP) / words,
        )
        for k, column in enumerate(columns):
            measures[:, k] = column
    bare = np.setdiff1d(np.arange(n_docs), rows)
    order = np.argsort(np.concatenate((rows, bare)), kind="stable")
    measures = np.concatenate((measures, np.zeros((len(bare), len(MEASURES)))))[order]
    length = np.concatenate((length, np.zeros(len(bare))))[order]
    per_doc = np.bincount(np.concatenate((rows, bare)).astype(np.int64), minlength=n_docs)
    offsets = np.concatenate(([0], np.cumsum(per_doc)))
    return _features(measures, offsets), length, offsets


def _features(measures: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kinds = len(MEASURES)
    own = np.stack([np.searchsorted(bounds, measures[:, k], side="left") for k, bounds in enumerate(MEASURES.values())], axis=1)
    before, after = np.full_like(own, _WIDTH), np.full_like(own, _WIDTH)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[offsets[:-1]] = _WIDTH
    after[offsets[1:] - 1] = _WIDTH
    shift = np.arange(kinds) * (_WIDTH + 1)
    block = kinds * (_WIDTH + 1)
    return np.concatenate((own + shift, before + shift + block, after + shift + 2 * block), axis=1)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> crf.ChainModel:
    """Fit on the lines of at most ``sample`` labelled documents outside the held-out fold."""
    bounded_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for chunk in chunks(batch):
                features, _, offsets = lines(chunk)
                found += [features[a:b].astype(np.int16).ravel() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([pa.array(np.array(batch.column("id"), dtype=str)), batch.column("label"), pa.array(found, pa.list_(pa.int16()))], names=["id", "label", "features"])

    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, sample, doc_id, text)
    got = rows.mapInArrow(extract, "id string, label int, features array<smallint>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    width = 3 * len(MEASURES)
    documents = [np.asarray(x.values).reshape(-1, width) for x in got.column("features")]
    truth = got.column("label").to_numpy()
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in documents]))).astype(np.int64)
    features = np.concatenate([*documents, np.zeros((0, width), np.int16)]).astype(np.int64)
    return crf.train(features, offsets, np.repeat(truth, np.diff(offsets)).astype(np.int64), N_FEATURES, 2)


def quality(docs: DataFrame, model: crf.ChainModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every row: id, held_out, score, predicted.

    Null, empty and blank texts count as one line of length zero and get that line's probability. A
    null id is never held out. An empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for chunk in chunks(batch):
                features, length, offsets = lines(chunk)
                good = crf.marginals(shared.value, features, offsets)[:, 1]
                length = np.maximum(length, 1)
                found.append(np.add.reduceat(good * length, offsets[:-1]) / np.add.reduceat(length, offsets[:-1]))
            yield pa.record_batch([batch.column("id"), pa.array(np.clip(np.concatenate([*found, np.zeros(0)]), 0, 1))], names=["id", "score"])

    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
