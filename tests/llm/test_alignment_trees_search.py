"""Tokenizer alignment, repeated windows and ranked search against plain versions of them."""

import collections
import hashlib
import itertools
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import alignment, lexical, suffix_trees

DOCS = "doc_id long, text string, id string, n string, block string, terms string"
needs_vocabularies = pytest.mark.skipif(not Path(alignment.FOLDER, alignment.BYTE_BPE).exists(), reason="the public vocabularies aren't here")


def _docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], DOCS).repartition(parts)


def _odd_texts(rng, n):
    """Texts of characters of all kinds: letters, marks, digits, blanks, controls and emoji."""
    kinds = ["abcdefgh", "ÀÉîßœ", "0123456789", " \n\t\r", "  　", "中文字", "दिल्ली", "😀👩‍💻🏳", ".,;!?'’\"", "\x00\x07\x1b", "'s't're've'm'll'd", "<|endoftext|><s></s>▁"]
    return ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 80))) for _ in range(n)]


# Alignment.


def _plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    bpe.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_BPE}")
    named = {k: t for t, k in bpe.get_vocab().items()}
    byte = alignment._byte_of_character()
    out, held = [], collections.Counter()
    for text in texts:
        text = text or ""
        whole = (" " + text).encode()
        a, b = bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        parts_a = [bytes(byte[c] for c in named[k]) for k in a]
        parts_b = [bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            out.append(None)
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, parts_a))), list(itertools.accumulate(map(len, parts_b)))
        spans_a, spans_b = list(zip([0, *ends_a], ends_a)), list(zip([0, *ends_b], ends_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups = [(lo, hi) for lo, hi in zip([0, *both], both)]
        written = ";".join(
            ",".join(str(k) for k, (x, y) in zip(a, spans_a) if lo <= x and y <= hi) + "|" + ",".join(str(k) for k, (x, y) in zip(b, spans_b) if lo <= x and y <= hi) for lo, hi in groups
        )
        links = [(k, m) for k, (x, y) in zip(a, spans_a) for m, (u, v) in zip(b, spans_b) if x < v and u < y]
        held.update(set(links))
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, "", 0, 0) if x is None else (*x[:3], len(x[3]), x[4], sum(held[p] == best[p[0]] for p in x[3]), sum(held[p] for p in x[3])) for x in out]


@needs_vocabularies
def test_alignment_by_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "harbour", "naïve", "antidisestablishment", "don't", "12345", "Straße", "..."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)] + _odd_texts(rng, 60)
    texts += [None, "", " ", "\n\n", "two  blanks", " leading", "x" * 3000, "<|endoftext|>", "<s> <0x41>", texts[0], texts[0]]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    want = _plain_alignment(texts)
    # Blocks of a few texts, so that counts come from many dictionaries.
    got = alignment.aligned(_docs(spark, rows), block_bytes=400).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {r["id"]: tuple(r[c] for c in names) for r in got} == {i: w for (i, _), w in zip(rows, want)} and len(got) == len(rows)
    assert sum(w[0] > 0 for w in want) > 60 and any(w[0] == 0 and t for w, t in zip(want, texts))
    empty = alignment.aligned(_docs(spark, []))
    assert empty.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"] and empty.count() == 0


@needs_vocabularies
def test_byte_level_tokens_are_those_of_the_vocabularys_own_library():
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_BPE}")
    bpe.encode_special_tokens = True
    texts = _odd_texts(random.Random(8), 3000)
    assert alignment.ByteBpe(f"{alignment.FOLDER}/{alignment.BYTE_BPE}").encode(texts) == [e.ids for e in bpe.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_transducer_memoises_moves_and_forgets(monkeypatch):
    first, second = [b"a", b"ab", b"abc", b"b", b"c"], [b"a", b"b", b"c", b"ca", b"bc"]
    machine = alignment.Transducer(first, second)
    side, closes = machine.read([2, 0, 3], [0, 4, 0, 1])  # abc a b | a bc a b
    assert closes.tolist() == [False, False, True, False, True, False, True] and side.tolist() == [False, True, True, False, True, False, True]
    known = dict(machine.moves)
    machine.read([2, 0, 3], [0, 4, 0, 1])
    assert machine.moves == known
    monkeypatch.setattr(alignment, "MOST_MOVES", 1)
    assert machine.read([1, 4, 0], [0, 1, 3])[1].sum() == 2 and machine.moves.keys() != known.keys()
    for a, b in (([0], [1]), ([0], []), ([1], [0]), ([], [2])):
        with pytest.raises((ValueError, StopIteration)):
            machine.read(a, b)


# Repeated windows.


def _plain_removal(rows, window):
    at = collections.defaultdict(list)
    read = []
    for k, (i, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        read.append(words)
        if i is not None:
            for s in range(len(words) - window + 1):
                at[tuple(words[s : s + window])].append((i, s, k))
    gone = [set() for _ in rows]
    for places in at.values():
        first = min(places)[:2]
        for i, s, k in places:
            if (i, s) > first:
                gone[k].update(range(s, s + window))
    return [(i, len(w), len(g), " ".join(x for p, x in enumerate(w) if p not in g)) for (i, _), w, g in zip(rows, read, gone)]


@pytest.mark.parametrize("share,least,often", [(4096, 1 << 16, 8), (2, 3, 2)])
def test_repeated_windows_by_brute_force(spark, monkeypatch, share, least, often):
    monkeypatch.setattr(suffix_trees, "OFTEN", often)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)] + ["É", " x", "the"]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [prose(rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in range(160):
        own = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            own[(at := rng.randint(0, len(own))) : at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(own)))
    # Copies, rows that share an id, repeated rows, rows without one, a hot word, periods, and texts a word short of a window.
    rows += [(500 + k, rows[3][1]) for k in range(6)] + [(-1, rows[4][1]), (7, rows[8][1]), (7, "extra " + rows[7][1]), (9, rows[9][1]), (None, rows[10][1]), (None, " ".join(passages[0]))]
    rows += [(600, "x " * 400), (601, "x " * 399 + "y"), (602, "a b c " * 60), (603, None), (604, ""), (605, " ".join(prose(19))), (606, "  lone  ")]
    want = _plain_removal(rows, 20)
    got = suffix_trees.without_repeats(_docs(spark, rows, 5), share=share, least=least).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted((str(i), *x) for i, *x in want)
    for r in got:
        assert sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2])) == r["n_removed"]
    assert sum(w[2] > 0 for w in want) > 60
    short = suffix_trees.without_repeats(_docs(spark, rows), window=3, share=share, least=least).collect()
    assert sorted((str(r["id"]), r["n_removed"], r["kept"]) for r in short) == sorted((str(i), n, s) for i, _, n, s in _plain_removal(rows, 3))
    assert suffix_trees.without_repeats(_docs(spark, [])).count() == 0


def test_prefixes_get_longer_where_many_suffixes_begin_alike(spark):
    rng = random.Random(2)
    head = "one two three four five six seven eight"
    rows = [(i, " ".join([head, *(f"r{rng.randint(0, 10**6)}" for _ in range(16))] * 3)) for i in range(200)]
    shape = suffix_trees.Shape(20)
    known = suffix_trees.plan(_docs(spark, rows).select("text"), shape, share=100, least=50)
    assert len(known.short[0]) == 1 and len(known.short[1]) == 0
    found = [np.array([known.short[0][0], 5], np.uint64), np.zeros(2, np.uint64), np.zeros(2, np.uint64)]
    assert known.lengths(found).tolist() == [2, 1]


# Search.


def _plain_search(docs, items, best):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = [(i, collections.Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    held = [(i, c) for i, c in read if c]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    holders = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        terms = set(term.findall((text or "").translate(lower)))
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * holders[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k, None if missing else i, -s) for k, (s, missing, i) in enumerate(sorted(found)[:best], 1)]
    return out


@pytest.mark.parametrize("shard,block,longest,first", [(8 << 20, 400_000, 64, 64), (300, 12, 3, 2), (1000, 1, 1, 10)])
def test_search_by_brute_force(spark, shard, block, longest, first):
    rng = random.Random(11)
    words = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(500)] + ["Été", "x1", "ß"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(None, "rare t1 t2"), (900, "rare t1 t2"), (900, "rare t1 t2"), (901, None), (902, "!!"), (903, "RARE rare, rare"), (904, "t1 " * 5000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(30)] + [(40, "rare"), (41, None), (42, "unheard"), (43, "t1"), (43, "t1"), (None, "t2 t3")]
    frame = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit("clash"))
    index = lexical.build_index(_docs(spark, docs, 4), shard_bytes=shard)
    got = lexical.search(index, frame, block_terms=block, longest=longest, first=first).collect()
    assert sorted(map(str, ((r["item_id"], r["rank"], r["id"], r["score"]) for r in got))) == sorted(map(str, _plain_search(docs, items, 10)))
    assert lexical.search(index, frame.where("item_id > 99")).count() == 0
    assert lexical.search(lexical.build_index(_docs(spark, [])), frame).count() == 0


def test_blocks_are_the_best_ones():
    rng = np.random.default_rng(4)
    lists = [rng.integers(1, 100, n) for n in (1, 2, 7, 9, 0, 8)]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    price, longest = 60.0, 4
    first = set(lexical.variable_blocks(np.concatenate(lists), starts, price, longest).tolist())

    def cost(x, cuts):
        edges = [0, *cuts, len(x)]
        parts = [x[a:b] for a, b in zip(edges, edges[1:])]
        return math.inf if any(len(p) > longest for p in parts) else sum(price + (p.max() - p).sum() for p in parts)

    for x, lo in zip(lists, starts):
        if len(x):
            own = sorted(k - lo for k in first if lo < k < lo + len(x))
            assert lo in first and cost(x, own) == min(cost(x, c) for n in range(len(x)) for c in itertools.combinations(range(1, len(x)), n))


def test_most_documents_are_skipped():
    """Of 4,000 documents, few of which hold the rare term, the others' bounds stay below the tenth best."""
    rng = np.random.default_rng(6)
    n = 4000
    common, rare = np.arange(n), np.sort(rng.choice(n, 60, replace=False))
    terms = np.array([3, 9], np.uint64)
    rows, times = np.concatenate((common, rare)), np.concatenate((rng.integers(1, 4, n), rng.integers(1, 30, 60)))
    steps = np.concatenate((np.diff(common, prepend=0), np.diff(rare, prepend=0)))
    shard = lexical.Shard(np.full(n, 50), terms, np.array([0, n, n + 60]), steps, times)
    items = lexical.Items(terms, np.array([5, 4000]), [np.array([0, 1])])
    postings = lexical.Postings(shard, items, lexical.Corpus(n, 50 * n), lexical.LONGEST, lexical.PRICE)
    looked_at, exact = [], postings.exact
    postings.exact = lambda lists, rows: looked_at.append(len(rows)) or exact(lists, rows)
    found, scores = postings.best(np.array([0, 1]), 1, 10, 64)
    whole = exact(np.array([0, 1]), np.arange(n))
    assert sorted(scores)[-10:] == sorted(whole)[-10:] and sum(looked_at) < 200
