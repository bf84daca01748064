"""Alignment of two tokenizers by a dangling-suffix transducer.

Both tokenizers cut the same bytes. The transducer reads a token of the side that lags: its state is
which side leads and the bytes of that side that the other hasn't matched yet. A move depends on
these bytes and the next token alone, so moves are memoised by (state, token); over prose nearly all
of them are known after a few texts. Where nothing dangles, both sides have ended a token at the same
byte and a group of tokens closes. Every token but the first of a group overlaps the leader's last
token when it is read, so moves also give all links between overlapping tokens.

How many documents hold a pair of tokens linked is a count over all documents. Tasks write blocks of
documents, each with a dictionary of its pairs; pairs are counted over the dictionaries, and the
counts come back to the blocks, so what is shuffled is pairs of blocks, not links of documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sieve import dealt_join
from .storage import settle
from .textbatch import Chunk, bounded_batches, chunks, pick

#: The folder of the public vocabularies, which executors have at the same path, and the files used.
FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Fixed value: how byte-level vocabularies of this kind part texts before merging.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text in a block, and moves that are memoised before the memo is started anew.
BLOCK_BYTES = 8 << 20
MOST_MOVES = 1 << 20
#: Bits of a token in a key of a move or a pair.
BITS = 20

class ByteBpe:
    """A byte-level vocabulary: ids of tokens are the ranks of their merges, and special tokens are plain text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        byte = _byte_of_character()
        ranks = {bytes(byte[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token
        self._encoding = tiktoken.Encoding("byte-bpe", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + text) for text in texts]


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as it is and the other bytes from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class PieceBpe:
    """A vocabulary of pieces with byte fallback, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self._model.get_piece_size())
        self.bytes = [bytes([int(self._model.id_to_piece(k)[3:5], 16)]) if self._model.is_byte(k) else self._model.id_to_piece(k).replace("▁", " ").encode() for k in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Transducer:
    """Reads two token sequences over the same bytes; ``moves`` and ``states`` grow with what is read."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.sides = (first, second)
        self._forget()

    def _forget(self) -> None:
        #: (side that leads, its unmatched bytes); in state 0 nothing dangles.
        self.states: list[tuple[int, bytes]] = [(1, b"")]
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.leads: list[bool] = [False]
        self.moves: dict[int, int] = {}

    def _move(self, state: int, token: int) -> int:
        """The side that lags reads ``token``; without anything dangling it is the first side, as if the second led."""
        lead, rest = self.states[state]
        own = self.sides[1 - lead][token]
        if len(own) > len(rest):
            lead, rest, own = 1 - lead, own, rest
        if not rest.startswith(own):
            raise ValueError("the two sides are not tokens of the same bytes")
        rest = rest[len(own) :]
        if not rest:
            return 0
        key = (lead, rest)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.leads.append(lead == 0)
        return self.numbers[key]

    def read(self, first: list[int], second: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """After each token, in the order of reading: whether it was of the second side, and whether a group closed."""
        if len(self.moves) > MOST_MOVES:
            self._forget()
        moves, leads, next_first, next_second = self.moves, self.leads, iter(first).__next__, iter(second).__next__
        n = len(first) + len(second)
        trail = [0] * n
        state = 0
        for k in range(n):
            token = next_second() if leads[state] else next_first()
            key = state << BITS | token
            try:
                state = moves[key]
            except KeyError:
                state = moves[key] = self._move(state, token)
            trail[k] = state
        if state:
            raise ValueError("the two sides are not tokens of the same bytes")
        after = np.array(trail, dtype=np.int64)
        return np.array(leads, dtype=bool)[np.concatenate(([0], after[:-1]))] if n else np.zeros(0, bool), after == 0


class Aligner:
    """Both tokenizers, the transducer and the strings of token ids, made once in each Python worker."""

    def __init__(self, first: ByteBpe, second: PieceBpe):
        self.first, self.second = first, second
        self.transducer = Transducer(first.bytes, second.bytes)
        # A token's id after what parts it from the token before: groups, tokens of a side, and the sides of a group.
        self._names = [f"{mark}{k}" for mark, side in ((";", first), (",", first), ("|", second), (",", second)) for k in range(len(side.bytes))]
        size = len(first.bytes)
        self._at = np.array([0, size, 2 * size, 2 * size + len(second.bytes)])

    def tokens(self, texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """Both token sequences of each text; none if one of them doesn't give back a space and the text."""
        plain = [t.decode() for t in texts]
        out = []
        for text, a, b in zip(texts, self.first.encode(plain), self.second.encode(plain)):
            whole = b" " + text
            same = bool(text) and b"".join(map(self.first.bytes.__getitem__, a)) == whole and b"".join(map(self.second.bytes.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out

    def align(self, chunk: Chunk) -> "Aligned":
        """Groups and links of all texts of a chunk; every text ends with nothing dangling, so they are read as one."""
        pairs = self.tokens([chunk.text(k) for k in range(chunk.hi - chunk.lo)])
        n_a, n_b = (np.array([len(p[side]) for p in pairs], dtype=np.int64) for side in (0, 1))
        a, b = [t for p in pairs for t in p[0]], [t for p in pairs for t in p[1]]
        second, closes = self.transducer.read(a, b)
        at_a, at_b = np.cumsum(~second) - 1, np.cumsum(second) - 1
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends = np.cumsum(n_a + n_b)
        row = np.searchsorted(ends, np.arange(len(second)), side="right")
        begins = np.concatenate(([True], closes[:-1]))[: len(closes)]
        link = ~begins
        links = ids_a[at_a[link]] << BITS | ids_b[at_b[link]]
        n_groups = np.bincount(row[closes], minlength=len(pairs))
        return Aligned(n_a, n_b, n_groups, links, row[link], self._digests(ids_a, ids_b, second, closes, at_a, at_b, ends))

    def _digests(self, ids_a, ids_b, second, closes, at_a, at_b, ends) -> list[str]:
        group = np.cumsum(np.concatenate(([0], closes[:-1])))[: len(closes)]
        # The first side's tokens of a group before the second's; within a side, reading order is theirs.
        order = np.argsort(group * 2 + second, kind="stable")
        token = np.where(second, ids_b[np.maximum(at_b, 0)] if len(ids_b) else 0, ids_a[at_a] if len(ids_a) else 0)[order]
        key = (group * 2 + second)[order]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        names = list(map(self._names.__getitem__, (self._at[(key & 1) * 2 + ~fresh] + token).tolist()))
        out, lo = [], 0
        for hi in ends.tolist():
            out.append(hashlib.sha256("".join(names[lo:hi])[1:].encode()).hexdigest() if hi > lo else "")
            lo = hi
        return out


class Aligned:
    """What is known of a chunk's texts: counts, links (pair and row of each) and digests of the groups."""

    def __init__(self, n_a, n_b, n_groups, links, rows, digests):
        self.n_a, self.n_b, self.n_groups, self.links, self.rows, self.digests = n_a, n_b, n_groups, links, rows, digests


@lru_cache(maxsize=2)
def _aligner(folder: str) -> Aligner:
    return Aligner(ByteBpe(f"{folder}/{BYTE_BPE}"), PieceBpe(f"{folder}/{PIECE_BPE}"))


def packed(values: np.ndarray) -> bytes:
    """Rising positions as their differences, byte plane by byte plane: small differences leave planes of zeros to compress."""
    return planes(np.diff(values, prepend=0))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data))


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4")[:, None].view(np.uint8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ENCODED = f"{_COUNTS}, block long, places binary, times binary, pairs array<bigint>, holders array<bigint>"
_NAMES = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "places", "times", "pairs", "holders"]


def _encode(folder: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then a row with the block's dictionary: its pairs and how many of its documents hold each."""
        aligner = _aligner(folder)
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.Array, Aligned]] = []
        size = 0
        for batch in batches:
            for chunk in chunks(batch):
                held.append((batch.column("id").slice(chunk.lo, chunk.hi - chunk.lo), aligner.align(chunk)))
                size += len(chunk.data)
                if size >= block_bytes:
                    yield _block(held, first)
                    held, size, first = [], 0, first + 1
        if held:
            yield _block(held, first)

    return run


def _block(held: list[tuple[pa.Array, Aligned]], number: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([i for i, _ in held])
    n = len(ids)
    starts = np.cumsum([0, *(len(i) for i, _ in held)])
    rows, pairs, times = [], [], []
    for start, (_, own) in zip(starts, held):
        order = np.lexsort((own.links, own.rows))
        row, link = own.rows[order], own.links[order]
        cuts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (link[1:] != link[:-1])))[: len(row)])
        rows.append(row[cuts] + start)
        pairs.append(link[cuts])
        times.append(np.diff(np.append(cuts, len(row))))
    rows, pairs, times = np.concatenate(rows), np.concatenate(pairs), np.concatenate(times)
    entries, places = np.unique(pairs, return_inverse=True)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    spans = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    whole = {name: np.concatenate([getattr(own, name) for _, own in held]) for name in ("n_a", "n_b", "n_groups")}
    # Tokens but the first of a group are read while another one dangles, and have one link each.
    whole["n_links"] = whole["n_a"] + whole["n_b"] - whole["n_groups"]
    columns = [pa.concat_arrays([ids, pa.nulls(1, ids.type)])]
    columns += [pa.array(np.append(whole[name], 0)) for name in ("n_a", "n_b", "n_groups", "n_links")]
    columns.append(pa.array([d for _, own in held for d in own.digests] + [""]))
    columns.append(pa.array(np.full(n + 1, number)))
    columns.append(pa.array([packed(places[s]) for s in spans] + [None], pa.binary()))
    columns.append(pa.array([planes(times[s]) for s in spans] + [None], pa.binary()))
    lists = pa.list_(pa.int64())
    columns += [pa.array([None] * n + [entries], lists), pa.array([None] * n + [np.bincount(places, minlength=len(entries))], lists)]
    return pa.record_batch(columns, names=_NAMES)


def _summed(documents: pa.Table, entries: pa.Table) -> pa.Table:
    """The counts of one block's dictionary, summed over the links of its documents."""
    order = np.argsort(entries.column("place").to_numpy())
    count, top = entries.column("n").to_numpy()[order], entries.column("top").to_numpy()[order].astype(np.int64)
    best, total = [], []
    for places, times in zip(documents.column("places").to_pylist(), documents.column("times").to_pylist()):
        at, times = unpacked(places), from_planes(times)
        best.append(int(times @ top[at]))
        total.append(int(times @ count[at]))
    out = documents.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.append_column("n_best", pa.array(best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, count, blocks, top): documents that hold a pair linked, blocks with it, and whether no pair of its first token is in more documents."""
    entries = encoded.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "holders")).alias("e"))
    counted = entries.groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.holders").alias("count"), F.count("*").alias("blocks"))
    # A first token has no more pairs than the second vocabulary has tokens.
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", BITS)))
    return counted.select("pair", "count", "blocks", (F.col("count") == highest).alias("top"))


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Align the tokens of both vocabularies in every text.

    Returns one row for each input row: id, n_a, n_b (tokens of either side), n_groups (of tokens
    between neighbouring byte offsets where both sides end a token), n_links (pairs of tokens whose
    bytes overlap), groups_sha256, n_best (links that are in as many documents as any link of their
    first token is), count_sum (over the links, how many documents hold the pair linked).

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have zeros and
    an empty digest. Identifiers may be of any type, null or repeated; a repeated row is a document of
    its own in the counts. An empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    encoded = settle(rows.mapInArrow(_encode(folder, block_bytes), f"id {kind}, {_ENCODED}"), "aligned-texts")
    counts = settle(pair_counts(encoded), "pair-counts")
    places = encoded.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("place", "pair"))
    # A pair of common words is in every block's dictionary.
    entries = dealt_join(places, counts.select("pair", F.col("count").alias("docs"), "top", F.col("blocks").alias("n")), "pair", F.col("block"))
    entries = entries.select(F.col("block").alias("of_block"), "place", F.col("docs").alias("n"), "top")
    written = encoded.where("pairs IS NULL")
    linked = written.where("n_links > 0").select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "places", "times")
    out = f"id {kind}, {_COUNTS}, n_best long, count_sum long"
    summed = linked.groupBy("block").cogroup(entries.groupBy("of_block")).applyInArrow(_summed, out)
    none = F.lit(0).cast("long")
    rest = written.where("n_links = 0").select("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", none.alias("n_best"), none.alias("count_sum"))
    return summed.unionByName(rest)
