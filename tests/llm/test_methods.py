"""Each operator's method against a plain version of it, and that the method is what does the work."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.llm import crf, exact, html_extract, pii, pipeline, quality, sieve, simhash, storage, suffixes, textbatch, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)


# Toxicity.


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(1)
    place = np.full(toxicity.BUCKETS, -1)
    place[[5, 9, 11, 40]] = range(4)
    machine = toxicity.FactorisationMachine(place, -0.3, rng.random(4), rng.normal(size=4), rng.normal(size=(4, 3)))
    docs = [[5, 9, 11], [9, 9, 7], [], [40, 5, 11, 9]]
    got = machine.score(np.repeat(range(4), [len(d) for d in docs]), np.array(sum(docs, []), dtype=np.int64), 4)
    for d, score in zip(docs, got):
        at = sorted({int(place[b]) for b in d} - {-1})
        x, w, v = machine.value, machine.weights, machine.factors
        raw = machine.bias + sum(w[i] * x[i] for i in at) + sum((v[i] @ v[j]) * x[i] * x[j] for i, j in itertools.combinations(at, 2))
        assert score == pytest.approx(1 / (1 + np.exp(-raw)))


def _planted_pairs(n, seed):
    """Insult 1 is toxic beside group 2 and not beside group 4; insult 3 the other way round. Both groups are as common in clean texts."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 2
        (own,) = rng.choices([{1, 2}, {3, 4}], [7, 3]) if toxic else rng.choices([{1, 4}, {3, 2}, {2}], [3, 4, 3])
        docs.append(np.array(sorted(own | set(rng.sample(range(100, 160), 20))), dtype=np.int64))
        labels.append(float(toxic))
    return docs, np.array(labels)


def test_pairs_are_learned_where_single_terms_say_nothing():
    docs, labels = _planted_pairs(3000, 1)
    held, truth = _planted_pairs(1000, 2)
    _, alone = toxicity._errors(docs, labels)
    assert max(abs(alone[[2, 4]])) < toxicity.LEAST_ERRORS and {2, 4} <= set(toxicity.kept_terms(docs, labels).tolist())
    rows, buckets = np.repeat(range(len(held)), [len(d) for d in held]), np.concatenate(held)

    def right(**kw):
        return float(((toxicity.fit(docs, labels, **kw).score(rows, buckets, len(held)) >= 0.5) == (truth == 1)).mean())

    assert right() > 0.97 and right(factors=0) < right() - 0.05


def test_pairs_are_learned_where_neither_half_speaks():
    """A text is toxic if it has exactly one of two terms, each of which is as common under either label."""

    def made(n, seed):
        rng = random.Random(seed)
        own = [{t for t in (7, 9) if rng.random() < 0.5} for _ in range(n)]
        return [np.array(sorted(o | set(rng.sample(range(100, 400), 12))), dtype=np.int64) for o in own], np.array([float(len(o) == 1) for o in own])

    (docs, labels), (held, truth) = made(3000, 1), made(1000, 2)
    assert (abs(toxicity._errors(docs, labels)[1][[7, 9]]) < toxicity.LEAST_ERRORS).all() and toxicity.kept_terms(docs, labels).tolist() == [7, 9]
    rows, buckets = np.repeat(range(len(held)), [len(d) for d in held]), np.concatenate(held)
    right = {k: float(((toxicity.fit(docs, labels, factors=k).score(rows, buckets, len(held)) >= 0.5) == (truth == 1)).mean()) for k in (0, toxicity.FACTORS)}
    assert right[toxicity.FACTORS] > 0.97 and right[0] < 0.8
    assert not len(toxicity.kept_terms([], np.zeros(0)))


def test_pairs_are_counted_over_all_blocks(monkeypatch):
    docs, labels = _planted_pairs(600, 4)
    among, toxic = np.array(sorted({int(t) for d in docs for t in d})), labels == 1
    monkeypatch.setattr(toxicity, "PAIR_ERRORS", 2.5)
    has = np.array([[t in set(d.tolist()) for t in among] for d in docs])
    brute = set()
    for a, b in itertools.combinations_with_replacement(range(len(among)), 2):
        both = has[:, a] & has[:, b]
        share = both.mean()
        if both.sum() >= toxicity.PAIR_DOCUMENTS and abs(both[toxic].mean() - both[~toxic].mean()) / np.sqrt(share * (1 - share) * (1 / toxic.sum() + 1 / (~toxic).sum())) >= 2.5:
            brute |= {int(among[a]), int(among[b])}
    for block in (7, 512):
        monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
        assert set(toxicity._paired_terms(docs, labels, among).tolist()) == brute
    assert 5 < len(brute) < len(among)


def test_gradient_by_differences():
    """Training lowers the loss that score() implies, down to where small changes of a factor don't help."""
    docs, labels = _planted_pairs(400, 3)
    machine = toxicity.fit(docs, labels, epochs=200, ridge=1e-3)
    rows, buckets = np.repeat(range(len(docs)), [len(d) for d in docs]), np.concatenate(docs)

    def loss():
        p = np.clip(machine.score(rows, buckets, len(docs)), 1e-9, 1 - 1e-9)
        fit = -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()
        return fit + 0.5e-3 * ((machine.weights**2).sum() + (machine.factors**2).sum())

    base = loss()
    for k in range(len(machine.weights)):
        for f in range(machine.factors.shape[1]):
            slope = []
            for step in (-1e-4, 1e-4):
                machine.factors[k, f] += step
                slope.append(loss())
                machine.factors[k, f] -= step
            assert abs(slope[1] - slope[0]) / 2e-4 < 0.02 and min(slope) > base - 1e-4


# Main text.


def _site(n, told):
    """Pages of three sites with menus, boxes and footers that no tag or class names, if not ``told``."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    pages, truth = [], {}
    for i in range(n):
        host = f"site{i % 3}.example"
        body = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(2, 5))]
        menu = "".join(f"<li>{host} part {k}</li>" for k in range(5))
        boxes = f"<div class='c7'><ul>{menu}</ul></div><p>Read {host} every day of the week</p>"
        foot = f"<section><div>All texts of {host} are its own</div><div>Write to the office</div></section>"
        if told:
            boxes, foot = f"<nav>{boxes}</nav>", f"<footer>{foot}</footer>"
        title = f"Title {i}"
        pages.append((i, f"https://{host}/{i}", f"<html><body><div>{boxes}</div><div class='x1'><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in body)}</div>{foot}</body></html>"))
        truth[i] = "\n".join([title, *body])
    return pages, truth


def test_templates_are_found_without_telling_names(spark):
    pages, truth = _site(90, told=False)
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["id"]: r["text"] for r in html_extract.main_text(frame).collect()} == truth
    # Without the step nothing goes, so it changes every page.
    without = {r["id"]: r["text"] for r in html_extract.main_text(frame, least_pages=10**9).collect()}
    assert all(without[i] != t and t in without[i] for i, t in truth.items())
    told, truth = _site(90, told=True)
    assert {r["id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(told, frame.schema)).collect()} == truth


def test_recurring_subtrees_by_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        subtrees = [{"subtree": rng.randint(1, 12), "line": False, "beside": rng.choice([None, *range(9)])} for _ in range(rng.randint(0, 4))]
        for s in subtrees:
            s["line"] = s["subtree"] % 2 == 0
        rows.append((rng.choice("ab"), rng.randint(1, 60), subtrees))
    frame = spark.createDataFrame(rows, "host string, whole long, subtrees array<struct<subtree:bigint,line:boolean,beside:bigint>>")
    got = {tuple(r) for r in html_extract.recurring(frame, 3, 0.05, 0.12).select("host", "subtree").collect()}
    host_pages, seen = collections.defaultdict(set), collections.defaultdict(set)
    for host, whole, subtrees in rows:
        host_pages[host].add(whole)
        for s in subtrees:
            if s["beside"] is not None:
                seen[host, s["subtree"]].add((s["beside"], whole))
    want = set()
    for (host, subtree), pairs in seen.items():
        texts = len({b for b, _ in pairs})
        if texts >= 3 and 2 * texts >= len(pairs) and texts >= (0.12 if subtree % 2 == 0 else 0.05) * len(host_pages[host]):
            want.add((host, subtree))
    assert got == want and want


@pytest.mark.parametrize(
    "page",
    [
        "<div class='long-form'><p>Article</p></div>", "<article class='post social-sciences'>Article</article>", "<div id='content' class='no-sidebar layout'>Article</div>",
        "<div class='page-with-comments'>Article</div>", "<p title='the hidden door'>Article</p>", "<div class='sidebar'><p>Article</p></div>",
        "<p hidden>no</p><p>Article</p>", "<div role=navigation>no</div><div style='display: none'>no</div>Article", "<div class='cookie-banner'>no</div>Article", "<p>Article<span class=ad-box>no</span> <a class='skip' href=x>no</a></p>", "<h1>Article</h1><section id=reader-comments>a comment that is much longer</section>",
    ],
)
def test_names_of_elements(page):
    assert [t for t, _, main in html_extract.parse(page) if main] == ["Article"]


def test_very_long_and_repeated_pages(spark):
    long = "<p>" + "word " * 200_000 + "</p>" + "<div>" * 3000 + "deep"
    rows = [(1, "http://a.b/1", long), (1, "http://a.b/1", long), (2, "http://a.b/2", "<p>x</p>")]
    got = sorted((r["id"], r["n_chars"]) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, 1_000_004), (1, 1_000_004), (2, 1)]


# SimHash.


def test_tree_finds_all_pairs_and_prunes_groups():
    rng = random.Random(6)
    prints = set()
    for _ in range(300):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 4)):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
    nodes = {}
    for x in prints:
        nodes.setdefault(x >> 43, []).append(x)
    members, number = [], []
    for k, node in enumerate(sorted(nodes, key=_rank)):
        for x in sorted(nodes[node], key=_rank):
            members.append(x)
            number.append(k)
    tree = simhash.GrayTree.of(np.array(members, dtype=np.uint64), np.array(number))
    a, b = tree.near(2)
    want = {(i, j) for i, j in itertools.combinations(range(len(members)), 2) if number[i] == number[j] and bin(members[i] ^ members[j]).count("1") <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and want
    assert tree.pruned > len(members) and tree.visited < len(members) ** 2 / 20


def _rank(x):
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> shift
    return x


def test_gray_rank_is_the_position_in_the_code(spark):
    codes = [k ^ (k >> 1) for k in range(64)]
    got = spark.createDataFrame([(c,) for c in codes], "c long").select(simhash.gray_rank(F.col("c"))).collect()
    assert [r[0] for r in got] == list(range(64))


def test_one_document_of_each_near_group_stays(spark):
    rng = random.Random(2)
    words = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n)]
    base = [words(200) for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        if rng.random() < 0.5:
            w[rng.randrange(200)] = "zzz"
        rows.append((i, " ".join(w)))
    # A null identifier beside others, two alone, and an identifier with two texts.
    rows += [(None, rows[0][1]), (None, "quite another text of some words"), (None, "quite another text of some words"), (3, "and this one has its own words too")]
    found = {(r["id"], r["fp"]): (r["component_id"], r["root"]) for r in simhash._grouped(_docs(spark, rows), "doc_id", "text", 2).collect()}
    kept = simhash.drop_near_duplicates(_docs(spark, rows))
    fp = {t: simhash.fingerprint(t.encode()) for _, t in rows}
    groups = collections.Counter()
    for r in kept.collect():
        signed = fp[r["text"]] - (1 << 64) if fp[r["text"]] >> 63 else fp[r["text"]]
        component, root = found[r["doc_id"], signed]
        assert r["doc_id"] == component
        groups[root] += 1
    assert set(groups) == {root for _, root in found.values()} and set(groups.values()) == {1}


# Exact dedup.


def test_filter_never_denies_its_keys(spark):
    keys = spark.range(0, 5000, 2).withColumnRenamed("id", "k")
    held = sieve.Filter.of(keys, 2500, "k")
    assert held.bits >= 2500 * sieve.BITS_A_KEY / 2
    rows = held.admits(spark.range(5000).withColumnRenamed("id", "k"), F.col("k")).collect()
    assert all(r["__maybe"] for r in rows if r["k"] % 2 == 0)
    assert sum(r["__maybe"] for r in rows if r["k"] % 2) < 0.15 * 2500
    nothing = sieve.Filter.of(keys.limit(0), 0, "k").admits(keys, F.col("k"))
    assert nothing.where("__maybe").isEmpty() and nothing.count() == 2500


def test_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    docs = _docs(spark, [(i, rng.choice(["a b", "ab ", "c", "d e f", f"only {i}"])) for i in range(120)])
    wide = sorted(map(tuple, exact.exact_duplicates(docs).collect()))
    monkeypatch.setattr(sieve, "MOST_BITS", 1)
    monkeypatch.setattr(sieve, "CELL", 1)
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect())) == wide


def test_equal_digests_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact, "_digest", lambda norm: F.unhex(F.substring(F.sha2(norm.cast("binary"), 256), 1, 1)))
    rows = [(i, f"text {i % 37}" + " " * (i % 3)) for i in range(150)]
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in exact.exact_duplicates(_docs(spark, rows)).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.replace(" ", "")].append((-len(t), i))
    assert got == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_runs_are_sorted_and_looked_up(spark):
    docs = _docs(spark, [(i, f"text {i % 40}") for i in range(100)])
    path = storage.new_path(spark, "runs")
    runs = exact.flush(exact.digests(docs), path)
    for file in runs.inputFiles():
        seen = [bytes(r["digest"]) for r in spark.read.parquet(file).collect()]
        assert seen == sorted(seen)
    assert sorted(r["id"] for r in exact.look_up(runs, "te xt 7", "text 8").collect()) == [7, 8, 47, 48, 87, 88]
    assert {r["n"] for r in exact.merged(runs).collect()} == {2, 3}


# Repeated passages.


def test_common_lengths_of_sorted_suffixes():
    rng = np.random.default_rng(3)
    size = rng.integers(0, suffixes.REACH + 1, 200)
    words = rng.integers(1, 3, (200, suffixes.REACH)).astype(np.uint64)
    words[np.arange(suffixes.REACH) >= size[:, None]] = 0
    order = sorted(range(200), key=lambda k: tuple(words[k, : size[k]].tolist()))
    words, size = words[order], size[order]
    got = suffixes._common(words, size, np.zeros(200, np.int64))
    for k in range(1, 200):
        n = 0
        while n < min(size[k], size[k - 1]) and words[k, n] == words[k - 1, n]:
            n += 1
        assert got[k] == n
    assert got[0] == -1 and suffixes._common(words, size, np.arange(200))[1:].max() == -1


# Personal data.


def test_a_name_is_found_at_every_place_of_a_long_line():
    field, n = pii.model(), 1000
    texts = [" ".join(["lorem"] * k + ["my name is Anna Lindqvist,"] + ["ipsum"] * (n - k)) for k in range(n)]
    found = []
    for chunk in textbatch.chunks(textbatch.pa.record_batch([textbatch.pa.array(texts)], names=["text"])):
        found += [(chunk.lo + row, texts[chunk.lo + row][a:b]) for row, a, b, _ in pii.learned_spans(chunk, field)]
    assert found == [(k, "Anna Lindqvist") for k in range(n)]


def test_repeated_words_are_no_names():
    text = "\n".join(" ".join([w] * 20) for w in ("Onou", "The", "For", "Hare", "Call", "Name"))
    (chunk,) = textbatch.chunks(textbatch.pa.record_batch([textbatch.pa.array([text])], names=["text"]))
    assert pii.learned_spans(chunk, pii.model()) == []


# Quality.


def test_quality_is_the_length_weighted_mean_of_marginals(spark):
    rng = np.random.default_rng(8)
    model = crf.ChainModel(rng.normal(size=(quality.N_FEATURES, 2)) * 0.3, rng.normal(size=(2, 2)), rng.normal(size=2))
    texts = ["One line of it.\nAND ANOTHER!! ONE\n\n x | y | z ", "", "a b c\nd e\nf g h 1 2 3\nok"]
    got = {r["id"]: r["score"] for r in quality.quality(_docs(spark, list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        (chunk,) = textbatch.chunks(textbatch.pa.record_batch([textbatch.pa.array([text])], names=["text"]))
        features, _, _ = quality.lines(chunk)
        lengths = [max(len(x), 1) for x in text.split("\n") if x.strip()] or [1]
        emit, total, good = model.scores(features), 0.0, np.zeros(len(features))
        for path in itertools.product((0, 1), repeat=len(features)):
            weight = np.exp(model.first[path[0]] + sum(emit[k, y] for k, y in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            good += weight * np.array(path)
        assert got[i] == pytest.approx(float((good / total * lengths).sum() / sum(lengths)))


# The pipeline.


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and a benchmark, and the documents' rows."""
    rng = random.Random(11)
    words = lambda n: [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit", "sed", "magna"]) + str(rng.randint(0, 99)) for _ in range(n)]
    items = [" ".join(words(40)) for _ in range(5)]
    rows = []
    for i in range(400):
        w = words(60)
        if i % 5 == 0:
            w[10:10] = rng.sample(["nasty", "vile", "awful"], 2)
        if i % 23 == 0:
            w[20:20] = rng.choice(items).split()[5:30]
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3"]), i))
    rows += [(500 + k, rows[k][1] + " ", *rows[k][2:]) for k in range(0, 60, 3)]
    rows += [(600 + k, rows[k][1].replace("lorem1", "lorem2", 1), *rows[k][2:]) for k in range(1, 90, 4)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_toxic_documents_go(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r["id"]: r["score"] for r in toxicity.toxicity(docs, model).collect()}
    kept = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, folder).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in kept) == (i % 5 > 0) for i in held) > 0.95 * len(held)


def test_the_pipeline_is_its_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, folder)
        after = {r["doc_id"]: r["text"] for r in made.collect()}
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items() and after
        if name == "exact dedup":
            best = {}
            for i, t in before.items():
                key = "".join(t.split())
                best[key] = min(best.get(key, (1, 0)), (-len(t), i))
            assert set(after) == {i for _, i in best.values()}
        if name == "near dedup":
            assert len({simhash.fingerprint(t.encode()) for t in after.values()}) == len(after) < len(before)
        if name != "mixing":
            assert made.columns == docs.columns
            docs = storage.settle(made, "stage")
    assert {r["doc_id"] for r in pipeline.run(spark, folder).collect()} == set(after)
    assert pipeline.run(spark, folder).columns == [*docs.columns, "mix_topic", "mix_weight", "mix_probability"]


def test_long_spans_of_large_documents_are_cut_out(spark, tmp_path):
    item, prose = " ".join(f"item{k}" for k in range(90)), [f"w{k}" for k in range(4000)]
    rows = [(1, " ".join([*prose[:2000], item, *prose[2000:]])), (2, " ".join([*prose[:50], item])), (3, None), (4, " ".join([*prose[:2000], " ".join(item.split()[:30]), *prose[2000:]])), (5, "clean")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.drop_contaminated(spark, _docs(spark, rows), str(tmp_path)).collect()}
    want = {1: " ".join(prose[:2000]) + "  " + " ".join(prose[2000:]), 3: None, 4: rows[3][1], 5: "clean"}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}


def test_settled_tables_can_be_deleted(spark):
    import os

    one, other = storage.settle(spark.range(3), "one"), storage.settle(spark.range(4), "other")
    storage.discard(one)
    path = other._settled_at.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(one._settled_at.removeprefix("file://").removeprefix("file:")) and os.path.exists(path) and other.count() == 4


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sieve, "KEY_ROWS", 10)
    rows = spark.createDataFrame([(i, i % 40 if i % 2 else 0) for i in range(400)] + [(900, None)], "id long, k long")
    table = rows.where("k < 30").groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    for how in ("inner", "left"):
        plain = rows.join(table.drop("n"), "k", how)
        got = sieve.dealt_join(rows, table, "k", F.col("id"), how)
        assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_an_article_card_is_not_the_page(spark):
    story, teaser = "The long story. " * 40, "A teaser."
    pages = {
        f"<div class=story><h1>Head</h1><p>{story}</p></div><div class=more><article>{teaser}</article></div>": f"Head\n{story.strip()}\n{teaser}",
        f"<article><h1>Head</h1><p>Short.</p></article><div>{story}</div>": "Head\nShort.",
        f"<main><p>{story}</p></main><div>Beside</div>": story.strip(),
        f"<nav>{story}</nav><p>Body</p><footer>Foot</footer><div role=search>Find</div><p>More <span role=alert>now</span></p>": "Body\nMore",
        "<h1>T</h1><p>Text</p>" + "".join(f"<div class='{c}'>no</div>" for c in ("legal-notice", "user-comments", "comment-body", "user-comments-section", "advertorial")): "T\nText",
    }
    frame = spark.createDataFrame([(k, "https://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r["id"]: r["text"] for r in html_extract.main_text(frame).collect()} == dict(enumerate(pages.values()))


def test_menus_that_name_themselves_are_found_by_counting_too():
    told, _ = _site(90, told=True)
    counts = collections.Counter(s["subtree"] for _, _, page in told for s in html_extract._evidence(html_extract.parse(page))[1] if s["beside"] is not None)
    assert sum(n >= 25 for n in counts.values()) >= 6
