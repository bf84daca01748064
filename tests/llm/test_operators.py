import collections
import html
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeloom.llm import components, crf, decontamination, exact, html_extract, licences, mixing, pii, quality, simhash, suffixes, textbatch, toxicity
from routeloom.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score string"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "a b c"), (6, "x " * 60_000), (7, "naïve café 12345 \U0001f600 end")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, None, "clash", "clash") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1000 + i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) for _ in range(40)]
        if i % 3 == 0:
            words[3:3] = rng.sample(["nasty", "vile", "awful"], 2)
        line = " ".join(words)
        rows.append((1000 + i, line if i % 4 else re.sub(r"(\w+)", r"\1$$$", line)))
    return _docs(spark, rows)


def test_all_operators_take_odd_rows_and_empty_tables(spark, odd, labels, trained):
    toxic, good = toxicity.learn(trained, labels), quality.learn(trained, labels)
    bench = spark.createDataFrame([(1, "word"), (2, None), (3, "")], "item_id long, text string")
    run = {
        "toxicity": lambda d: toxicity.toxicity(d, toxic),
        "quality": lambda d: quality.quality(d, good),
        "contamination": lambda d: decontamination.contamination(d, bench),
        "near": lambda d: simhash.near_duplicates(d),
        "exact": lambda d: exact.exact_duplicates(d),
        "pii": lambda d: pii.personal_data(d),
        "licences": lambda d: licences.licence_matches(d),
        "mixture": lambda d: mixing.mixture(d),
    }
    for name, f in run.items():
        assert f(odd).count() == len(ODD), name
        assert f(odd.limit(0)).count() == 0, name
    assert suffixes.repeated_passages(odd).count() == 0 and suffixes.repeated_passages(odd.limit(0)).count() == 0
    for f in (lambda d: toxicity.reject_toxic(d, toxic), exact.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: decontamination.decontaminate(d, bench), mixing.mix):
        assert f(odd).columns[:7] == odd.columns and f(odd.limit(0)).count() == 0
    assert exact.drop_exact_duplicates(odd).count() == 5  # one of the blank ones, and one of the repeated rows
    assert {r["id"] for r in decontamination.contamination(odd, bench).where("contaminated").collect()} == {4}
    # Without labels there is a model all the same.
    assert toxicity.toxicity(odd, toxicity.learn(trained, labels.limit(0))).count() == len(ODD)
    assert quality.quality(odd, quality.learn(trained, labels.limit(0))).count() == len(ODD)


def test_classifiers_on_held_out_rows(spark, trained, labels):
    for found, name in ((toxicity.toxicity(trained, toxicity.learn(trained, labels)), "toxic"), (quality.quality(trained, quality.learn(trained, labels)), "quality")):
        rows = found.where("held_out").join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
        right = sum(r["predicted"] == r[name] for r in rows) / len(rows)
        assert rows and right > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_field_agrees_with_enumeration():
    rng = np.random.default_rng(0)
    model = crf.ChainModel(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = [3, 1, 4, 2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    features = rng.integers(0, 6, (offsets[-1], 2))
    labels, inside = crf.decode(model, features, offsets), crf.marginals(model, features, offsets)
    emit = model.scores(features)
    for a, b in zip(offsets[:-1], offsets[1:]):
        paths = {}
        for path in np.ndindex(*(3,) * (b - a)):
            paths[path] = model.first[path[0]] + sum(emit[a + k, y] for k, y in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:]))
        assert tuple(labels[a:b]) == max(paths, key=paths.get)
        total = sum(np.exp(v) for v in paths.values())
        for k in range(b - a):
            for y in range(3):
                assert inside[a + k, y] == pytest.approx(sum(np.exp(v) for p, v in paths.items() if p[k] == y) / total)


def test_long_sequences_are_decoded_as_one():
    rng = np.random.default_rng(3)
    model = crf.ChainModel(rng.normal(size=(6, 3)), 2 * rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = [3, 50, 1, 16, 5, 4, 10, 8, 200]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    features = rng.integers(0, 6, (offsets[-1], 2))
    whole = crf.decode(model, features, offsets, block=1000)
    for block in (1, 2, 4, 7):
        assert crf.decode(model, features, offsets, block=block).tolist() == whole.tolist()


def test_word_spans_and_hashes():
    texts = ["", "ab  cd", "é", "cd ab", "  "]
    (chunk,) = textbatch.chunks(pa.record_batch([pa.array(texts)], names=["text"]))
    starts, ends, rows = textbatch.spans(chunk, ~textbatch.byte_class((9, 13), (32, 32)))
    assert [(int(r), chunk.data[a:b].tobytes().decode()) for a, b, r in zip(starts, ends, rows)] == [(1, "ab"), (1, "cd"), (2, "é"), (3, "cd"), (3, "ab")]
    h = textbatch.span_hash(chunk.data, starts, ends)
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3


def _brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(150)) for _ in range(8)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("XYZ")
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "ONE")]
    fp = {i: _brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            low = min(root[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 2)
            if low < root[i]:
                root[i], changed = low, True
    got = {r["id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(_docs(spark, rows)).collect()}
    assert got == {i: (fp[i], root[i]) for i in fp}


def test_dense_fingerprints_are_split_into_more_levels(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_LIMIT", 20)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 250:
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice((1, 2, 3, 5))):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)

    def classes(links):
        root = {x: x for x in prints}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in prints]

    found = simhash.similar_fingerprints(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    assert classes(map(tuple, found)) == classes((x, y) for x in prints for y in prints if x < y and bin((x ^ y) % 2**64).count("1") <= 2)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (9, 8), (7, 7), (None, 3)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(30)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (4, 5, 8, 9)} == {4} and {got[100 + i] for i in range(41)} == {100} and {got[600 + i] for i in range(30)} == {500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _brute_contamination(text, items, window=13):
    def ws(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    w = ws(text)
    hit, found = set(), set()
    for i, t in items:
        v = ws(t)
        m = min(window, len(v))
        for k in range(len(v) - m + 1) if v else ():
            for a in range(len(w) - m + 1):
                if w[a : a + m] == v[k : k + m]:
                    hit |= set(range(a, a + m))
                    found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_contamination_by_brute_force(spark, block_words):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "dd,", "É2"]) for _ in range(n))
    items = [(i, text(rng.choice((2, 5, 12, 13, 14, 30)))) for i in range(25)] + [(99, None), (98, "...")]
    rows = [(i, " ".join((text(rng.randint(0, 60)), rng.choice(items)[1] or "", text(20)))) for i in range(60)] + [(70, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.contamination(_docs(spark, rows), bench, block_words=block_words).collect()}
    want = {i: _brute_contamination(t, items) for i, t in rows}
    assert got == want
    assert {r["doc_id"] for r in decontamination.decontaminate(_docs(spark, rows), bench).collect()} == {i for i, x in want.items() if not x[3]}
    assert decontamination.remove_spans(b"One, two three. Four", [1, 3]) == b"One, . Four"


@pytest.mark.parametrize("limit", [50_000, 2])
def test_repeated_passages_by_brute_force(spark, limit):
    rng = random.Random(3)
    pool = [[rng.choice("abcde") for _ in range(rng.randint(40, 130))] for _ in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randint(0, 4)):
            p, a = rng.choice(pool), rng.randint(0, 30)
            w += p[a : a + rng.randint(20, 100)] if rng.random() < 0.6 else [rng.choice("abcde") for _ in range(rng.randint(1, 60))]
        rows.append((i, " ".join(w + ["x"] * rng.choice((0, 0, 80)))))
    rows += [(900, rows[5][1].upper()), (901, rows[6][1])]
    seen, words = collections.defaultdict(set), {i: t.lower().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    want = []
    for i, w in words.items():
        for k in range(len(w) - 49):
            who = seen[tuple(w[k : k + 50])]
            if len(who) > 1:
                if want and want[-1][0] == i and k <= want[-1][2]:
                    want[-1] = (i, want[-1][1], k + 50, min(want[-1][3], min(who)))
                else:
                    want.append((i, k, k + 50, min(who)))
    got = sorted((r["id"], r["start"], r["stop"], r["first_id"]) for r in suffixes.repeated_passages(_docs(spark, rows), limit=limit).collect())
    assert got == sorted(want)


def _base(t):
    def luhn(x):
        return sum((2 * int(c) - 9 if 2 * int(c) > 9 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(x[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub("[ -]", "", m.group())) <= 19 and luhn(re.sub("[ -]", "", m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]


def test_patterns_of_personal_data(spark):
    rng = random.Random(6)
    parts = ["a@b.c", "_d@e.f", "x", "é", " ", ".", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "+", "12", "-", "\n", "@q.r@s.t"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in pii.personal_data(_docs(spark, rows)).collect()}
    assert got == {i: _base(t) for i, t in rows}


def test_learned_personal_data(spark):
    rows = [(1, 'é the token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" end'), (2, "my name is Laura Bergman, bye"), (3, "Onou Onou. The name of it is old. With Water.")]
    got = {r["id"]: [(s["kind"], rows[r["id"] - 1][1][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.personal_data(_docs(spark, rows)).collect()}
    assert got == {1: [("secret", "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567")], 2: [("name", "Laura Bergman")], 3: []}


def test_personal_data_in_long_lines(spark):
    token = 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"'
    rows, want = [], {}
    for n in range(194, 204):
        rows += [(n, " ".join(["lorem"] * n + ["my name is Anna Lindqvist, and so on"] + ["ipsum"] * 300)), (n + 1000, " ".join(["lorem"] * n + [token] + ["ipsum"] * 300))]
        want |= {n: [("name", "Anna Lindqvist")], n + 1000: [("secret", token[9:-1])]}
    texts = dict(rows)
    got = {r["id"]: [(s["kind"], texts[r["id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.personal_data(_docs(spark, rows)).collect()}
    assert got == want


def test_pages(spark):
    page = "<body><nav>menu</nav><header><h1>Site</h1></header><main><h1>T &amp; u</h1><p>a &lt;b&gt;<p>c<br>d  e<ul><li>one<li>two</ul><div id='comments'><p>hey</p></div><div class=ad>buy</div><form>q</form></main><footer>f</footer>"
    shared = "<body><div class='x'><p>Follow us on all channels today</p></div><div><h1>T{0}</h1><p>text {0} " + "word " * 20 + "</p></div></body>"
    rows = [(i, f"http://a.com/{i}", shared.format(i)) for i in range(6)] + [(None, None, None), (9, "http://b.com/", page), (9, "http://b.com/", ""), (10, "http://c.com", "<div>Follow us")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["id"] or 0, r["text"], r["n_chars"]) for r in html_extract.main_text(pages).collect())
    body = "T & u\na <b>\nc d e\none\ntwo"
    want = [(i, f"T{i}\ntext {i} " + "word " * 19 + "word") for i in range(6)] + [(0, ""), (9, body), (9, ""), (10, "Follow us")]
    assert got == sorted((i, t, len(t)) for i, t in want)
    assert html_extract.main_text(pages.limit(0)).count() == 0
    assert [t for t, _, _ in html_extract.parse("<p>" + html.escape("<script>") + "<script>var a='</p>'</script> ok")] == ["<script> ok"]


def test_near_copies_of_articles_keep_their_parts(spark):
    parts = ["".join(f"<{tag}><p>{k} part of the article, {k * 7} words</p></{tag}>" for tag, k in (("div", 1), ("section", 2), ("div", 3)))]
    mirrors = [(i, f"http://m.com/{i}", f"<head><title>T{i}</title></head><body><script>var a={i}</script><nav><a>{i}</a></nav>{parts[0]}<div class=ad>buy {i}</div></body>") for i in range(6)]
    # A list that six of a thousand pages of a host share is no template; a box on all of them is one.
    large = [(100 + i, f"http://l.com/{i}", f"<body><div><p>Follow us</p></div><p>text of {i} and more words</p>{'<ul><li>shared list</ul>' if i < 6 else ''}</body>") for i in range(1000)]
    got = {r["id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(mirrors + large, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"1 part of the article, 7 words\n2 part of the article, 14 words\n3 part of the article, 21 words"}
    assert all(got[100 + i] == f"text of {i} and more words" + "\nshared list" * (i < 6) for i in range(1000))


def test_licences_by_brute_force(spark):
    texts = ["x\n\n" + licences.TEXTS["MIT"] + "\n\ny z", licences.TEXTS["BSD-3-Clause"], "Some prose of the day.\nReleased under the MIT licence.", "the of the in the\n of the", "Licensed under CC BY-NC 4.0."]
    bags = [(n, collections.Counter(zip(w, w[1:]))) for n, t in licences.templates() for w in [re.findall(r"[0-9a-z]+", t.lower())] if len(w) > 1]

    def brute(text):
        rows, best = [re.findall(r"[0-9a-z]+", x.lower().replace("licence", "license")) for x in text.split("\n")], {}
        for i in range(len(rows)):
            for j in range(i, len(rows)):
                w = sum(rows[i : j + 1], [])
                bag = collections.Counter(zip(w, w[1:]))
                for n, b in bags:
                    dice = 2 * (bag & b).total() / (bag.total() + b.total())
                    if dice >= 0.8:
                        best[n] = max(best.get(n, 0), round(dice, 9))
        return best

    got = {r["id"]: {m["licence"]: round(m["score"], 9) for m in r["matches"]} for r in licences.licence_matches(_docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_licences_inside_longer_lines(spark):
    prose = "lorem ipsum dolor sit amet " * 40
    one_line = " ".join(licences.TEXTS["MIT"].split())
    texts = [f"{prose}Released under the MIT License. {prose}", f"x\n{prose}(c) 2020 A. Licensed under CC BY-NC 4.0, see below.", f"{prose} {one_line} {prose}", f"{prose} {one_line.replace('deal in', 'trade with')} {prose}", f"{prose} released under the terms of the day {prose}"]
    got = {r["id"]: [(m["licence"], round(m["score"], 2), m["first_line"], m["last_line"]) for m in r["matches"]] for r in licences.licence_matches(_docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [("MIT", 1.0, 0, 0)], 1: [("CC-BY-NC-4.0", 1.0, 1, 1)], 2: [("MIT", 1.0, 0, 0)], 3: [("MIT", 0.98, 0, 0)], 4: []}


def test_queries_match_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, None if i == 3 else " ".join(rng.choice(("aa", "bb!!", "a | b c |", "$$$x", "Released")) for _ in range(rng.randint(0, 30))), rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "s3")), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = mixing.mixture(docs).withColumns({c: F.round(c, 6) for c in ("weight", "probability")})
    want = con.sql(ORACLES["op3_mixing"]).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    want = con.sql(ORACLES["op9_exact_dedup"]).fetchall()
    assert sorted(tuple(r) for r in exact.exact_duplicates(docs).collect()) == sorted(want)
    kept = {r[0] for r in want if r[3]}
    assert {r["doc_id"] for r in exact.drop_exact_duplicates(docs).collect()} == kept
    assert {r["doc_id"] for r in mixing.mix(docs).collect()} == {r[0] for r in con.sql(ORACLES["op3_mixing"]).fetchall() if r[7]}


def test_calibration_keeps_the_share(spark):
    cells = spark.createDataFrame([("a", 100, 5.0), ("b", 300, 1.0), ("c", 600, 0.2)], "k string, tokens long, weight double")
    got = mixing.calibrate(cells, 0.5).collect()
    assert sum(r["probability"] * r["tokens"] for r in got) == pytest.approx(500) and max(r["probability"] for r in got) == 1


def test_raking_meets_all_targets(spark):
    rng = random.Random(12)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rng.randint(0, 5) * rng.randint(1, 900)) for a in range(7) for b in range(3) for c in range(4) if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = mixing.targets_by_power(cells)
    assert sum(r["target"] for r in targets["lang"].collect()) == pytest.approx(sum(r[3] for r in rows))
    fitted = mixing.rake(cells, targets, tolerance=1e-4)
    assert fitted.columns == [*cells.columns, "weight"] and fitted.count() == len(rows)
    assert max(mixing.residuals(fitted, targets).values()) < 1e-4
    # After one round only the last dimension's targets are met.
    missed = mixing.residuals(mixing.rake(cells, targets, rounds=1), targets)
    assert missed["topic"] < 1e-9 and missed["source"] > 1e-4
