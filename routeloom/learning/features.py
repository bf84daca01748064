"""Features of request texts: five structural ones and TF-IDF over character n-grams.

Fitting is a distinct over texts and two groupings over their n-grams; only the vocabulary, which is
bounded by the settings, comes to the driver. Transforming is one projection: no join or exchange.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.contracts import FeatureConfig
from routeloom.functions.text import STRUCTURAL, is_blank, normalised, strip, structural_features
from routeloom.learning.regression import pack


#: Characters of texts whose n-grams are counted at once, and numbers that a table of next states may have.
CHUNK = 1 << 21
TABLE = 1 << 24
#: What separates texts: no character.
END = 0x110000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def count_ngrams(texts: list[str], low: int, high: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The n-grams of texts, how often each occurs, and in how many of the texts.

    An n-gram and the number of its text are one integer, so sorting integers brings equal ones
    together. Where the characters are too many for that, n-grams are counted one by one.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    points = code_points("\0".join([*texts, ""])).copy()
    points[np.cumsum(sizes) - 1] = END
    seen = np.zeros(END + 1, bool)
    seen[points] = True
    seen[END] = False
    alphabet = np.flatnonzero(seen)
    ids = np.zeros(END + 1, np.int64)
    ids[alphabet] = np.arange(1, len(alphabet) + 1)
    ids = ids[points]
    bits, text_bits = len(alphabet).bit_length(), len(texts).bit_length()
    if bits * high + text_bits > 63:
        return _counted_singly(texts, low, high)
    number = np.repeat(np.arange(len(texts)), sizes)
    terms, totals, documents = [], [], []
    code, whole = ids, ids > 0
    for n in range(1, high + 1):
        if n > 1:
            code, whole = code[:-1] << bits | ids[n - 1 :], whole[:-1] & (ids[n - 1 :] > 0)
        if n < low or not whole.any():
            continue
        keys = np.sort((code << text_bits | number[: len(code)])[whole])
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        grams = keys[at] >> text_bits
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        totals.append(np.diff(np.append(at[first], len(keys))))
        documents.append(np.diff(np.append(first, len(at))))
        letters = grams[first][:, None] >> (bits * np.arange(n - 1, -1, -1)) & ((1 << bits) - 1)
        joined = alphabet[letters - 1].astype("<u4").tobytes().decode("utf-32-le")
        terms += [joined[i : i + n] for i in range(0, len(joined), n)]
    none = [np.zeros(0, np.int64)]
    return terms, np.concatenate(none + totals), np.concatenate(none + documents)


def _counted_singly(texts: list[str], low: int, high: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    total: Counter[str] = Counter()
    documents: Counter[str] = Counter()
    for text in texts:
        own = [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
        total.update(own)
        documents.update(set(own))
    return list(total), np.array(list(total.values()), np.int64), np.array([documents[t] for t in total], np.int64)


def _counted(low: int, high: int):
    def counted(texts: list[str]) -> pa.RecordBatch:
        terms, totals, documents = count_ngrams(texts, low, high)
        return pa.record_batch([pa.array(terms, pa.string()), pa.array(totals, pa.int64()), pa.array(documents, pa.int64())], names=["term", "total", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(term, total, documents) of the n-grams of normalised texts, chunk by chunk."""
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if held and size + len(text) > CHUNK:
                    yield counted(held)
                    held, size = [], 0
                held.append(text)
                size += len(text) + 1
        if held:
            yield counted(held)

    return run


def prepared(texts: DataFrame, text: str = "query") -> DataFrame:
    """Texts with the columns that features are made from instead of the text."""
    own = structural_features(F.col(text))
    return texts.withColumns({NORMAL: normalised(F.col(text)), MEASURED: F.array(*[own[c] for c in STRUCTURAL])}).drop(text)


def _normal(texts: DataFrame, text: str) -> Column:
    return F.col(NORMAL) if NORMAL in texts.columns else normalised(F.col(text))


def term_totals(texts: DataFrame, config: FeatureConfig, text: str = "query") -> DataFrame:
    """(term, total, documents) of all n-grams of distinct texts, summed in batches before they are dealt by term."""
    counted = texts.select(_normal(texts, text).alias("text")).mapInArrow(_counted(*config.ngram_range), "term string, total long, documents long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("documents").alias("documents"))


def vocabulary(texts: DataFrame, config: FeatureConfig, text: str = "query") -> DataFrame:
    """The most frequent terms, ties in term order, with their totals and document counts."""
    return term_totals(texts, config, text).orderBy(F.desc("total"), "term").limit(config.max_features)


def structural_spread(texts: DataFrame, text: str = "query") -> DataFrame:
    """One row: the number of texts, and the population standard deviation of each structural feature."""
    measured = {n: F.col(MEASURED)[k] for k, n in enumerate(STRUCTURAL)} if MEASURED in texts.columns else structural_features(F.col(text))
    own = texts.select(*[c.alias(n) for n, c in measured.items()])
    return own.agg(F.count("*").alias("n"), *[F.stddev_pop(n).alias(n) for n in STRUCTURAL])


def idf(n_texts: int, documents: int) -> float:
    import math

    return math.log((1 + n_texts) / (1 + documents)) + 1


#: Texts whose n-grams one task counts.
TASK_TEXTS = 5_000
WEIGHTS = "struct<positions:array<int>,weights:array<double>>"
PACKED = "struct<positions:binary,counts:binary,scale:double>"
#: Columns of texts from which all features can be had, so that a text's patterns are looked for once.
NORMAL, MEASURED = "normal", "measured"


@dataclass(frozen=True)
class Weigh:
    """TF-IDF weights of normalised texts; plain data, so that tasks can be given it.

    A text's characters are followed through the terms all at once: a state is a beginning of a term,
    and a table tells which state comes next with which character.
    """

    low: int
    high: int
    places: dict[str, int]
    idf: np.ndarray

    @cached_property
    def states(self) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]] | None:
        """The number of each character, and for each length the table of next states and the states' places; 0 is none. None if a table would be too large."""
        letters = {c: k for k, c in enumerate(sorted(set("".join(self.places))), 1)}
        ids = np.zeros(END + 1, np.int32)
        ids[[ord(c) for c in letters]] = list(letters.values())
        before, following, places = letters, [], []
        for n in range(1, self.high + 1):
            if n > 1:
                own = {p: k for k, p in enumerate(sorted({t[:n] for t in self.places if len(t) >= n}), 1)}
                if (len(before) + 1) * (len(letters) + 1) > TABLE:
                    return None
                table = np.zeros((len(before) + 1) * (len(letters) + 1), np.int32)
                for p, k in own.items():
                    table[before[p[:-1]] * (len(letters) + 1) + letters[p[-1]]] = k
                following.append(table)
                before = own
            places.append(np.array([0, *(self.places.get(p, -1) + 1 for p in before)], np.int32))
        return ids, following, places

    def found(self, text: str) -> np.ndarray:
        """The places of all n-grams of the text that are terms, repeats included."""
        if self.states is None:
            place = self.places.get
            return np.array([k for n in range(self.low, self.high + 1) for i in range(len(text) - n + 1) if (k := place(text[i : i + n])) is not None], dtype=np.int32)
        ids, following, places = self.states
        own = ids[code_points(text)]
        wide, state, out = len(places[0]), own, []
        for n in range(1, self.high + 1):
            if n > 1:
                state = following[n - 2][state[:-1] * wide + own[n - 1 :]]
            if n >= self.low:
                out.append(places[n - 1][state])
        every = np.concatenate(out)
        return every[every > 0] - 1

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """The places of the terms of a text, how often each occurs, and what their counts times their weights are divided by."""
        counts = np.bincount(self.found(text))
        positions = np.flatnonzero(counts).astype(np.int32)
        return positions, counts[positions], float(np.sqrt(((counts[positions] * self.idf[positions]) ** 2).sum())) or 1.0

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        positions, counts, length = self.counted(text)
        return positions, counts * self.idf[positions] / length

    def packed(self, texts: pa.Array) -> pa.Array:
        made = [self.counted(text) for text in texts.to_pylist()]
        bytes_ = [pack(positions, counts, len(self.places)) for positions, counts, _ in made]
        columns = [pa.array([x[side] for x in bytes_], pa.binary()) for side in (0, 1)]
        return pa.StructArray.from_arrays([*columns, pa.array([1 / length for _, _, length in made], pa.float64())], names=["positions", "counts", "scale"])

    def batch(self, texts: pa.Array) -> pa.Array:
        made = [self(text) for text in texts.to_pylist()]
        ends = pa.array(np.cumsum([0, *(len(p) for p, _ in made)]), pa.int32())
        flat = [np.concatenate([x[side] for x in made]) if made else np.zeros(0) for side in (0, 1)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in zip(flat, (pa.int32(), pa.float64()))]
        return pa.StructArray.from_arrays(lists, names=["positions", "weights"])


@dataclass(frozen=True)
class FeatureModel:
    """What fitting learns; enough to transform, and plain JSON."""

    config: FeatureConfig
    scale: tuple[float, ...]
    terms: tuple[str, ...]
    weights: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.scale) + len(self.terms)

    def dense(self, text: Column) -> Column:
        """The scaled structural features, an array; a blank text is an error while running."""
        guarded = F.when(is_blank(text), F.raise_error(F.lit("query is blank")).cast("string")).otherwise(text)
        own = structural_features(guarded)
        return self._scaled([own[c] for c in STRUCTURAL])

    def _scaled(self, own: list[Column]) -> Column:
        return F.array(*[c / F.lit(s) for c, s in zip(own, self.scale)])

    def packed(self) -> tuple[Column, Column]:
        """The scaled structural features and the terms of ``prepared`` texts, as ``regression.PACKED`` has them."""
        return self._scaled([F.col(MEASURED)[k] for k in range(len(STRUCTURAL))]), F.arrow_udf(self.weigh.packed, PACKED)(F.col(NORMAL))

    @cached_property
    def weigh(self) -> "Weigh":
        return Weigh(*self.config.ngram_range, {term: k for k, term in enumerate(self.terms)}, np.array(self.weights))

    def sparse(self, text: Column) -> Column:
        """The TF-IDF weights as (positions, weights), by position and of length one unless there are none.

        Texts are normalised by Spark; n-grams are looked up in an Arrow function, batch by batch. The
        same in lambdas of built-in functions is interpreted: it took about 10 ms a text.
        """
        return F.arrow_udf(self.weigh.batch, WEIGHTS)(normalised(text))

    def to_json(self) -> str:
        return json.dumps({"ngram_range": list(self.config.ngram_range), "max_features": self.config.max_features, "scale": self.scale, "terms": self.terms, "weights": self.weights}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> "FeatureModel":
        x = json.loads(text)
        return cls(FeatureConfig(tuple(x["ngram_range"]), x["max_features"]), tuple(x["scale"]), tuple(x["terms"]), tuple(x["weights"]))


def fit_features(rows: DataFrame, config: FeatureConfig = FeatureConfig(), text: str = "query") -> FeatureModel:
    """Fit on the distinct stripped texts of ``rows``; a corpus too short for any n-gram has structural features only."""
    texts = rows.select(strip(F.col(text)).alias("query")).distinct().persist()
    try:
        return fit_distinct(texts, config)
    finally:
        texts.unpersist()


def fit_distinct(texts: DataFrame, config: FeatureConfig) -> FeatureModel:
    """Fit on texts that are stripped, distinct, perhaps ``prepared``, and persisted."""
    # A text that is normalised is blank if it is empty.
    if not texts.where(F.col(NORMAL) == "" if NORMAL in texts.columns else is_blank(F.col("query"))).isEmpty():
        raise ValueError("query is blank")
    spread = structural_spread(texts).first()
    if not spread["n"]:
        raise ValueError("no training queries")
    # A feature that never varies keeps its scale.
    scale = tuple(float(spread[n]) if spread[n] else 1.0 for n in STRUCTURAL)
    return FeatureModel(config, scale, *fit_terms(dealt(texts, spread["n"]), config, spread["n"]))


def fit_terms(texts: DataFrame, config: FeatureConfig, n: int) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """The vocabulary of ``n`` distinct texts and the weight of each term."""
    terms = vocabulary(texts, config).collect()
    return tuple(r["term"] for r in terms), tuple(idf(n, r["documents"]) for r in terms)


def tasks_for(spark: SparkSession, n: int) -> int:
    """As many tasks as the work on the n-grams of ``n`` texts asks for, which is much for their bytes."""
    return max(spark.sparkContext.defaultParallelism, n // TASK_TEXTS)


def dealt(texts: DataFrame, n: int) -> DataFrame:
    """``n`` texts, dealt again if they are in so few tasks that most cores would wait for the others."""
    tasks = tasks_for(texts.sparkSession, n)
    return texts.repartition(tasks) if 2 * texts.rdd.getNumPartitions() < tasks else texts


def read_features(spark: SparkSession, path: str) -> FeatureModel:
    return FeatureModel.from_json(spark.read.text(path, wholetext=True).first()["value"])
