"""Toxicity by a factorisation machine over hashed terms.

The score of a text is the logistic of a bias, a weight for every distinct term, and the inner
product of the factors of every two distinct terms, each scaled by how rare the term is; a pair that
is worse than its parts (an insult and whom it is aimed at) is learned by the factors. A term is a
lower-cased word or the beginning of a longer one, hashed: beginnings are shared by the forms and
compounds of a word, which are rare alone. A term gets parameters if its share differs between the
labels, by itself or in the company of terms that speak for label 1: whom an insult is aimed at may be
as common in clean texts as in toxic ones, and differs only beside the insult. Where neither half of a
pair says anything by itself, pairs of common terms are counted, and both halves get parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows
from .textbatch import Chunk, ascii_lower, bounded_batches, byte_class, chunks, mix, pick, span_hash, spans

#: Buckets of terms.
BUCKETS = 1 << 18
#: Lengths in bytes of the beginnings that longer words have as further terms.
BEGINNINGS = (4, 6, 8)
#: Labelled rows used for fitting, at most.
SAMPLE = 6000
#: Documents of the sample that a term must be in to get parameters.
LEAST_DOCUMENTS = 5
#: Standard errors by which a term's share of documents must differ between the labels to get parameters: of all documents, or of those with a term that speaks for label 1.
LEAST_ERRORS = 3.5
#: Documents that each half of a pair, and both together, must be in for the pair to be looked at, and the standard errors by which its share must differ; millions of pairs are looked at, so they are many.
HALF_DOCUMENTS, PAIR_DOCUMENTS, PAIR_ERRORS = 40, 20, 7.0
#: Terms whose pairs are counted at once.
PAIR_BLOCK = 512
FACTORS = 4
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

_WORD = byte_class((48, 57), (65, 90), (97, 122), (128, 255))
_LOWER = ascii_lower()


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all words of a chunk and of their beginnings, repeats included."""
    starts, ends, rows = spans(chunk, _WORD)
    lowered = _LOWER[chunk.data]
    all_rows, hashes = [rows], [span_hash(lowered, starts, ends)]
    for size in BEGINNINGS:
        longer = ends - starts > size
        all_rows.append(rows[longer])
        # Mixed once more with the size, so that a beginning isn't the word of the same letters.
        hashes.append(mix(span_hash(lowered, starts[longer], starts[longer] + size) + np.uint64(size)))
    return np.concatenate(all_rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(rows * n + terms)
    return keys // n, keys % n


@dataclass
class FactorisationMachine:
    """place: a bucket's position among the kept terms or -1; value, weights and factors: of the kept terms."""

    place: np.ndarray
    bias: float
    value: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, buckets: np.ndarray, n_rows: int) -> np.ndarray:
        """The probability of label 1 for every row; a row without known terms has the bias only."""
        at = self.place[buckets]
        rows, at = _distinct(rows[at >= 0], at[at >= 0], max(len(self.weights), 1))
        out = np.full(n_rows, self.bias)
        if len(rows):
            cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            out[rows[cuts]] += _raw(self.value, self.weights, self.factors, at, cuts)[0]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _raw(value: np.ndarray, weights: np.ndarray, factors: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of weights and of pairs for each document, and the sum of its factors."""
    own = factors[at] * value[at][:, None]
    total = np.add.reduceat(own, cuts)
    pairs = 0.5 * (total**2 - np.add.reduceat(own**2, cuts)).sum(axis=1)
    return np.add.reduceat(weights[at] * value[at], cuts) + pairs, total


def _errors(documents: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket: in how many documents it is, and by how many standard errors its share is higher under label 1."""
    every = np.concatenate([*documents, np.zeros(0, np.int64)]).astype(np.int64)
    spread = np.bincount(every, minlength=BUCKETS)
    toxic = np.bincount(every, weights=np.repeat(labels, [len(d) for d in documents]), minlength=BUCKETS)
    n, n1 = max(len(documents), 2), max(float(labels.sum()), 1.0)
    n0 = max(n - n1, 1.0)
    return spread, _standard_errors(spread, toxic, n, n1, n0)


def _standard_errors(spread: np.ndarray, toxic: np.ndarray, n: float, n1: float, n0: float) -> np.ndarray:
    share = np.minimum(np.maximum(spread, 1), n - 1) / n
    return (toxic / n1 - (spread - toxic) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))


def _paired_terms(documents: list[np.ndarray], labels: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the buckets ``among`` that are half of a pair whose share differs between the labels.

    Documents of a block of terms are a matrix, and counts of pairs the product of two of them, so
    that all pairs are looked at and memory is that of two blocks.
    """
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[among] = np.arange(len(among))
    at = place[np.concatenate([*documents, np.zeros(0, np.int64)])]
    document = np.repeat(np.arange(len(documents)), [len(d) for d in documents])[at >= 0]
    at = at[at >= 0]
    order = np.argsort(at, kind="stable")
    at, document = at[order], document[order]
    starts = range(0, len(among), PAIR_BLOCK)

    def block(lo: int) -> np.ndarray:
        a, b = np.searchsorted(at, (lo, lo + PAIR_BLOCK))
        out = np.zeros((min(PAIR_BLOCK, len(among) - lo), len(documents)), dtype=np.float32)
        out[at[a:b] - lo, document[a:b]] = 1
        return out

    n, n1 = max(len(documents), 2), max(float(labels.sum()), 1.0)
    toxic = labels == 1
    found = np.zeros(len(among), dtype=bool)
    for lo in starts:
        left = block(lo)
        for other in range(lo, len(among), PAIR_BLOCK):
            right = left if other == lo else block(other)
            both = left @ right.T
            differs = (both >= PAIR_DOCUMENTS) & (np.abs(_standard_errors(both, left[:, toxic] @ right[:, toxic].T, n, n1, max(n - n1, 1.0))) >= PAIR_ERRORS)
            found[lo : lo + len(left)] |= differs.any(axis=1)
            found[other : other + len(right)] |= differs.any(axis=0)
    return among[found]


def kept_terms(documents: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The buckets that get parameters: those that differ between the labels, alone, in company or as half of a pair."""
    spread, alone = _errors(documents, labels)
    kept = (spread >= LEAST_DOCUMENTS) & (np.abs(alone) >= LEAST_ERRORS)
    speaks = kept & (alone > 0)
    beside = np.array([speaks[d].any() for d in documents], dtype=bool)
    near, company = _errors([d for d, b in zip(documents, beside) if b], labels[beside])
    kept |= (near >= LEAST_DOCUMENTS) & (np.abs(company) >= LEAST_ERRORS)
    kept[_paired_terms(documents, labels, np.flatnonzero((spread >= HALF_DOCUMENTS) & ~kept))] = True
    return np.flatnonzero(kept)


def fit(documents: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = 60, batch: int = 400, rate: float = 0.05, ridge: float = 2e-5) -> FactorisationMachine:
    """Fit on distinct buckets of each document by Adam over shuffled batches, from a fixed seed; no ``factors`` leave the linear part."""
    rng = np.random.default_rng(7)
    share = min(max(float(np.mean(labels)) if len(labels) else 0.5, 0.01), 0.99)
    bias = float(np.log(share / (1 - share)))
    kept = kept_terms(documents, labels)
    spread = np.bincount(np.concatenate([*documents, np.zeros(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    value = np.log(len(documents) / spread[kept]) / np.log(max(len(documents), 2))
    params = [np.array([bias]), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), factors))]
    m, v, k = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    inside = [place[d][place[d] >= 0] for d in documents]
    for _ in range(epochs if len(kept) else 0):
        order = rng.permutation(len(inside))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            some, bare = [i for i in chosen if len(inside[i])], [i for i in chosen if not len(inside[i])]
            lengths = np.array([len(inside[i]) for i in some], dtype=np.int64)
            at, cuts = np.concatenate([*(inside[i] for i in some), np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum(lengths)))[:-1]
            raw, total = _raw(value, params[1], params[2], at, cuts) if some else (np.zeros(0), np.zeros((0, factors)))
            gap = 1 / (1 + np.exp(-np.clip(raw + params[0][0], -40, 40))) - labels[some]
            # A document without kept terms has its say on the bias.
            rest = (1 / (1 + np.exp(-np.clip(params[0][0], -40, 40))) - labels[bare]).sum()
            each = np.repeat(gap, lengths) * value[at]
            grads = [np.array([gap.sum() + rest]), np.bincount(at, weights=each, minlength=len(kept)), np.empty_like(params[2])]
            pull = each[:, None] * (np.repeat(total, lengths, axis=0) - params[2][at] * value[at][:, None])
            for f in range(factors):
                grads[2][:, f] = np.bincount(at, weights=pull[:, f], minlength=len(kept))
            k += 1
            for j, (p, g, a, b) in enumerate(zip(params, grads, m, v)):
                g = g / len(chosen) + (ridge * p if j else 0)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return FactorisationMachine(place, float(params[0][0]), value, params[1], params[2])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; their distinct terms come to the driver."""
    bounded_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for chunk in chunks(batch):
                rows, buckets = _distinct(*terms(chunk), BUCKETS)
                found += np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, chunk.hi - chunk.lo)))
            yield pa.record_batch([pa.array(np.array(batch.column("id"), dtype=str)), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["id", "label", "terms"])

    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, sample, doc_id, text)
    got = rows.mapInArrow(extract, "id string, label int, terms array<int>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    # Repeated rows of one id may bring more rows than ids; the order above makes any fit the same.
    return fit([np.asarray(x.values, dtype=np.int64) for x in got.column("terms")], got.column("label").to_numpy().astype(float))


def toxicity(docs: DataFrame, model: FactorisationMachine, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every row: id, held_out, score, predicted.

    Null and empty texts have no terms: their score is the model's bias, the share of label 1. A
    repeated term counts once. A null id is never held out. An empty table gives no rows. Other
    columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            found = [machine.score(*terms(chunk), chunk.hi - chunk.lo) for chunk in chunks(batch)]
            yield pa.record_batch([batch.column("id"), pa.array(np.concatenate([*found, np.zeros(0)]))], names=["id", "score"])

    scored = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, in their own columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.record_batch([batch.column(at)], names=["text"])
            found = [shared.value.score(*terms(chunk), chunk.hi - chunk.lo) for chunk in chunks(texts)]
            yield batch.filter(pa.array(np.concatenate([*found, np.zeros(0)]) < threshold))

    return docs.mapInArrow(keep, docs.schema)
