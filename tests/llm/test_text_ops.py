"""Hashing, joins, classifier, fertility, licences, reputation: edge cases and brute force."""

import itertools
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from compare import rows_of, rows_of_sql

from lodestack.llm import common as C
from lodestack.llm import fertility, licenses, nbsvm, tokens, url_reputation
from lodestack.llm import ngram_join as J
from lodestack.llm.license_rules import RULES

LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, a string, b long, n int, k int"


def grams(t, n=3):
    w = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(rows, t, n=3):
    out = {}
    for (i, x), (j, y) in itertools.combinations(((i, grams(t_, n)) for i, t_ in rows), 2):
        if x and y and i != j:
            k = len(x & y)
            if k / (len(x) + len(y) - k) >= t - 1e-12:
                out[min(i, j), max(i, j)] = round(k / (len(x) + len(y) - k), 6)
    return out


def frame(spark, rows):
    """Extra columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "a", 1, 2, 3) for i, t in rows], DOCS)


def test_ngram_sets_match_words():
    texts = ["The quick, brown fox!", "the QUICK brown fox", "", None, "one", "one two", "ñandú über Straße größe", "a b c a b c a b c", "!!! ...", LONG]
    toks, counts = C.ngram_sets(pa.array(texts), 3)
    assert counts.tolist() == [len(grams(t)) for t in texts]
    parts = np.split(toks, np.cumsum(counts)[:-1])
    assert (parts[0] == parts[1]).all() and all((np.diff(p.astype(object)) > 0).all() for p in parts)
    assert len(np.unique(np.concatenate([p for p in parts[4:]]))) == sum(counts[4:])


@pytest.mark.parametrize("t,n", [(0.5, 3), (0.8, 3), (0.3, 2), (1.0, 1)])
def test_join_against_brute_force(spark, t, n):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choice(words, rng.integers(1, 80)).tolist()
        for c in range(rng.integers(1, 9)):
            own = list(base)
            for _ in range(rng.integers(0, 1 + len(own) // 6)):
                own[rng.integers(0, len(own))] = words[rng.integers(0, 300)]
            rows.append((len(rows), " ".join(own)))
    shared = " ".join(words[:60])
    rows += [(1000 + i, shared + " " + " ".join(rng.choice(words, 20))) for i in range(8)]
    got = {(a, b): s for a, b, s in J.jaccard_pairs(frame(spark, rows), n=n, threshold=t).collect()}
    assert got == brute_pairs(rows, t, n)


def groups_of(pairs):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


@pytest.mark.parametrize("divided", [False, True])
def test_groups_against_brute_force(spark, monkeypatch, divided):
    """Chains, copies and hot passages: groups are the components of all pairs, and divided buckets lose none."""
    if divided:
        monkeypatch.setattr(J, "SLOTS_A_TASK", 300)
        monkeypatch.setattr(J, "PAIRS_A_TASK", 10)
        monkeypatch.setattr(J, "TOKENS_A_TASK", 400)
        monkeypatch.setattr(J, "TOKENS_A_BUCKET", 500)
        monkeypatch.setattr(C, "MAX_PARTS", 3)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for g in range(6):
        text = rng.choice(words, 60).tolist()
        for c in range(14):  # a chain: each differs from the last in a few words, so the ends share little
            at = int(rng.integers(0, 56))
            text[at : at + 4] = rng.choice(words, 4).tolist()
            rows.append((len(rows), " ".join(text)))
    passage = " ".join(rng.choice(words, 30))
    rows += [(200 + i, passage + " " + " ".join(rng.choice(words, 40))) for i in range(30)]
    base = rng.choice(words, 50).tolist()
    for i in range(40):
        own = list(base)
        own[int(rng.integers(0, 50))] = f"own{i}"
        rows.append((300 + i, " ".join(own)))
    rows += [(400 + i, rows[i][1]) for i in range(0, 20, 4)]
    d = frame(spark, rows)
    want = brute_pairs(rows, 0.5)
    assert {(a, b): s for a, b, s in J.jaccard_pairs(d).collect()} == want
    assert {r["doc_id"]: r["root"] for r in J.near_duplicates(d).collect()} == groups_of(want)


def classes_of(rows, pairs):
    root, links = groups_of(pairs), {}
    for v in itertools.chain(*pairs):
        links[v] = links.get(v, 0) + 1
    return sorted((i, root.get(i, i), links.get(i, 0)) for i in {i for i, _ in rows if i is not None})


@pytest.mark.parametrize("way", ["whole", "blocks", "sparse"])
def test_classes_against_brute_force(spark, monkeypatch, way):
    """Every link of every document is counted, copies' too, in whole groups, in blocks and by candidates, and no pair has a row."""
    if way != "whole":
        monkeypatch.setattr(J, "DOCS_A_BLOCK", 5)
        monkeypatch.setattr(J, "TOKENS_A_TASK", 400)
        monkeypatch.setattr(J, "NGRAMS_A_PRODUCT", 7)
        monkeypatch.setattr(J, "DENSE", 2)
        monkeypatch.setattr(J, "SLOTS_AT_ONCE", 50)
        monkeypatch.setattr(J, "ROWS_A_BLOCK", 3)
        monkeypatch.setattr(J, "SPARSE", 1e-9 if way == "sparse" else 1e9)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for size in (1, 2, 2, 3, 14, 40):
        base = rng.choice(words, 50).tolist()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.integers(0, 6)):
                own[int(rng.integers(0, 50))] = words[int(rng.integers(0, 900))]
            rows.append((len(rows) - 20, " ".join(own)))
    text = rng.choice(words, 60).tolist()
    for _ in range(25):  # a chain, whose ends share little
        at = int(rng.integers(0, 56))
        text[at : at + 4] = rng.choice(words, 4).tolist()
        rows.append((len(rows) - 20, " ".join(text)))
    rows += [(500 + i, t) for i, t in rows[::3]] + [(900 + i, rows[0][1]) for i in range(4)] + [(950, "alone in the world"), (951, None), (952, "?!"), (None, rows[5][1]), (953, "one two three"), (954, "One, two three.")]
    found = J.jaccard_classes(frame(spark, rows)).collect()
    pairs = brute_pairs([r for r in rows if r[0] is not None and r[1]], 0.5)
    assert sorted(map(tuple, found)) == classes_of(rows, pairs) and sum(r["links"] for r in found) == 2 * len(pairs) > 2000
    assert J.jaccard_classes(frame(spark, [])).count() == 0


def test_overlaps_of_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = ([rng.choice(np.arange(1000, 1000 + int(k), dtype=np.uint64), 20, replace=False) for k in rng.choice([25, 60, 4000], size)] for size in (30, 17))
    want = [[len({*x.tolist()} & {*y.tolist()}) for y in b] for x in a]
    for dense, width, slots in ((128, 2048, 10**6), (0, 2048, 3), (10**6, 5, 3), (4, 3, 7)):
        monkeypatch.setattr(J, "DENSE", dense)
        monkeypatch.setattr(J, "NGRAMS_A_PRODUCT", width)
        monkeypatch.setattr(J, "SLOTS_AT_ONCE", slots)
        assert J._overlaps(a, b).tolist() == want


def test_rows_of_the_join_grow_with_documents(spark, tmp_path):
    """A group of near copies twice as large gives twice the rows of op3, not four times."""
    from lodestack.llm.queries import QUERIES

    words = [f"w{i}" for i in range(60)]
    counts = []
    for size in (40, 80):
        frame(spark, [(i, " ".join([*words, f"own{i}"])) for i in range(size)]).write.parquet(f"{tmp_path}/{size}/documents.parquet")
        got = QUERIES["op3_ngram_jaccard_join"](spark, f"{tmp_path}/{size}").collect()
        assert {(r["class_id"], r["links"]) for r in got} == {(0, size - 1)}
        counts.append(len(got))
    assert counts == [40, 80]


def test_buckets_share_partitions_beyond_the_limit(spark):
    d = spark.range(1000).selectExpr("cast(id % 37 as int) as b", "id")
    fn = lambda t: pa.table({"b": t.column("b").slice(0, 1), "n": pa.array([t.num_rows], pa.int64()), "s": pa.array([sum(t.column("id").to_pylist())], pa.int64())}).to_batches()
    want = sorted((b, len(v := range(b, 1000, 37)), sum(v)) for b in range(37))
    for parts in (37, 5, 1):
        got = C.by_bucket(d, 37, "b", fn, "b int, n long, s long", parts)
        assert sorted(map(tuple, got.collect())) == want and got.rdd.getNumPartitions() == parts


def test_join_edges(spark):
    rows = [(1, None), (None, "a b c d"), (2, ""), (3, "one"), (4, "One!"), (5, "a b c d"), (6, "A b, c d"), (7, LONG), (8, LONG + " tail"), (9, "?!"), (5, "a b c d")]
    got = {(a, b): s for a, b, s in J.jaccard_pairs(frame(spark, rows)).collect()}
    assert set(got) == {(3, 4), (5, 6), (7, 8)} and got[3, 4] == got[5, 6] == 1
    assert J.jaccard_pairs(frame(spark, [])).count() == 0
    kept = J.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 5, 7, 9]
    clash = frame(spark, [(1, "z z z y"), (1, "a b c d"), (2, "A b c d")])  # of two texts of an id the smaller counts
    assert [tuple(r)[:2] for r in J.jaccard_pairs(clash).collect()] == [(1, 2)]


def test_choose_m_is_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(50):
        df = np.sort(rng.integers(2, 1000, rng.integers(1, 60))).astype(float)
        k1 = int(rng.integers(1, len(df) + 1))
        cost = [(df[: k1 + m - 1] - 1).sum() * (1 + J.VERIFY_COST / m) for m in range(1, len(df) - k1 + 2)]
        assert J.choose_m(df, k1) == int(np.argmin(cost)) + 1


@pytest.mark.parametrize("local", [10_000, 0])
def test_components(spark, local):
    e = [(1, 2), (2, 3), (5, 4), (6, 7), (7, 8), (9, 8), (9, 6), (10, 11), (3, 1)]
    got = {r["doc_id"]: r["root"] for r in J.components(spark.createDataFrame(e, "a long, b long"), local).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10}


def brute_features(t):
    toks = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", (t or "").encode())
    return len({(x,) for x in toks} | set(zip(toks, toks[1:])))


def test_nbsvm_features_and_fit():
    texts = ["Good words, here!", "", None, "AND!! AND!! AND!!", "ñ ü", LONG]
    _, n = nbsvm.features(pa.array(texts), 30)
    assert [abs(a - brute_features(t)) <= len(t or "") ** 2 / 2**28 + 0 for a, t in zip(n.tolist(), texts)] == [True] * 6
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(300):
        k = 1 if i % 3 else -1
        rows.append(np.unique(np.concatenate((rng.integers(0, 40, 8), rng.integers(40, 60, 4) if k > 0 else rng.integers(60, 80, 4)))).astype(np.int32))
        y.append(k)
    y = np.array(y)
    good, bad = (np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == s]), minlength=128) for s in (1, -1))
    r = nbsvm.log_ratio(good, bad)
    assert r == pytest.approx(np.where(good + bad >= 2, np.log((good + 1) / (good + 1).sum()) - np.log((bad + 1) / (bad + 1).sum()), 0))
    w, b = nbsvm.fit_hinge(rows, y, r, epochs=200)

    def objective(w, b):
        x = [r[f] / np.sqrt(r[f] @ r[f] + nbsvm.DAMPING) for f in rows]
        m = np.array([np.dot(w[f], v) + b for f, v in zip(rows, x)])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * m).sum()

    best = objective(w, b)
    for _ in range(200):  # the hinge objective is convex: no nearby point is lower
        assert objective(w + rng.normal(0, 0.01, len(w)), b + rng.normal(0, 0.01)) >= best - 0.02 * best


def test_nbsvm_held_out(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.1")
    docs, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = nbsvm.train(docs, lab.where("doc_id % 2 = 0"))
    s = nbsvm.score_quality(docs, model).join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r for r in s if r["quality"] == 1], [r for r in s if r["quality"] == 0]
    assert sum(r["accepted"] for r in good) / len(good) >= 0.995
    assert sum(not r["accepted"] for r in bad) / len(bad) >= 0.65


def test_nbsvm_held_out_repeated_words(spark, sf_dir):
    at = sf_dir.replace("0.001", "0.1")
    docs, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = nbsvm.train(docs, lab.where("doc_id % 2 = 0"))
    held = docs.join(lab.where("doc_id % 2 = 1 and quality = 0"), "doc_id").select("text").toPandas()["text"]
    words = [t.split() for t in held]
    repeated = [t for t, w in zip(held, words) if sum(a == b for a, b in zip(w, w[1:])) > 0.3 * len(w)]
    assert len(repeated) >= 50 and (model.score(pa.array(repeated)) < 0).mean() >= 0.95
    a, b = (set(nbsvm.features(pa.array([w * 300]))[0].tolist()) for w in ("Er ", "Ob. "))
    assert len(a & b) == len(nbsvm.REPEATED)


def test_nbsvm_against_plain_counts(spark, sf_dir):
    """Counts, sample, fit and scores, recomputed document by document."""
    for at in (sf_dir, sf_dir.replace("0.001", "0.01")):
        docs, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
        y = {r["doc_id"]: r["quality"] for r in lab.collect()}
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        feats = {i: nbsvm.features(pa.array([t]))[0] for i, t in texts.items()}
        count = np.zeros((2, 1 << nbsvm.BITS), int)
        for i in set(y) & set(texts):
            for f in feats[i].tolist():
                count[y[i], f] += 1
        r = nbsvm.log_ratio(count[1], count[0])
        ids = sorted(set(y) & set(texts))
        assert len(ids) <= nbsvm.FIT_ROWS
        w, b = nbsvm.fit_hinge([feats[i] for i in ids], np.array([1 if y[i] else -1 for i in ids]), r)
        got = {x["doc_id"]: (x["score"], x["accepted"]) for x in nbsvm.score_quality(docs, nbsvm.train(docs, lab)).collect()}
        assert set(got) == set(texts)
        for i, f in feats.items():
            want = sum(w[k] * r[k] for k in f.tolist()) / math.sqrt(sum(r[k] ** 2 for k in f.tolist()) + nbsvm.DAMPING) + b
            assert abs(got[i][0] - want) < 2e-5 and (got[i][1] == (want >= 0) or abs(want) < 2e-5)


def test_nbsvm_of_rare_class_and_few_documents(spark):
    """A bounded sample has both classes if the labelled documents have, whatever else is labelled."""
    rng = np.random.default_rng(3)
    good, bad = [f"fine{i}" for i in range(50)], [f"junk{i}!" for i in range(50)]
    rows = [(i, " ".join(rng.choice(bad if i % 100 == 7 else good, 60))) for i in range(1000)]
    lab = spark.createDataFrame([(i, 0 if i % 100 == 7 else 1) for i in range(1000)] + [(i, 1) for i in range(5000, 9000)], "doc_id long, quality int")
    m = nbsvm.train(frame(spark, rows), lab, fit_rows=40, class_rows=5)
    s = m.score(pa.array([t for _, t in rows]))
    assert all((v < 0) == (i % 100 == 7) for (i, _), v in zip(rows, s))


def test_nbsvm_edges(spark):
    rows = [(1, "fine words here and there"), (2, "junk!! junk!! junk!!"), (3, None), (4, ""), (None, "fine words"), (5, "fine good words"), (6, "junk!! more!!"), (5, "fine good words"), (7, LONG)]
    d = frame(spark, rows)
    lab = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, 0), (3, 1), (None, 1), (7, None), (4, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    m = nbsvm.train(d, lab)
    got = [(r["doc_id"], r["accepted"]) for r in nbsvm.score_quality(d, m).collect()]
    assert len(got) == 9 and dict(got)[1]
    assert nbsvm.filter_quality(d, m).columns == d.columns
    assert nbsvm.filter_quality(d, m).count() == sum(a for _, a in got)
    for none in (lab.limit(0), lab.where("quality = 1"), lab.where("doc_id = 99")):
        assert nbsvm.filter_quality(d, nbsvm.train(d, none)).count() == 9
    assert nbsvm.score_quality(d.limit(0), m).count() == 0


@pytest.mark.parametrize("name", ["piece", "multi"])
def test_tokens_equal_plain_encoding(name):
    v = tokens.vocabulary(fertility.VOCABULARIES[name])
    texts = ["Hello world", "", None, " lead", "two  blanks", "tail ", "line\nbreak and\n\n more", "ñandú 日本語 ☃ ok", "don't stop", "a", LONG[:5000], "tab\tand   nbsp", "mixed \n x"]
    want = v.encode([t or "" for t in texts])
    assert tokens.count(pa.array(texts), v).tolist() == [len(w) for w in want]
    seen = {}
    for rows, n, row, ids in tokens.encode(pa.array(texts), v):
        for k, r in enumerate(rows.tolist()):
            seen[r] = sorted(ids[row == k].tolist())
            assert n[k] == len(seen[r])
    assert [seen[i] for i in range(len(texts))] == [sorted(w) for w in want]


def brute_measure(t, v):
    ids = v.encode([t or ""])[0]
    n = max(len(ids), 1)
    h = -sum(c / n * math.log2(c / n) for c in (ids.count(i) for i in set(ids)))
    return len(t or "") / n, sum(bool(v.fallback[i]) for i in ids) / n, h / math.log2(n) if len(ids) > 1 else 1.0


@pytest.mark.parametrize("name", ["piece", "multi"])
def test_measures_against_brute_force(name):
    path = fertility.VOCABULARIES[name]
    texts = ["Hello hello hello world", "", None, "日本 ☃☃", "AND!! AND!! AND!!", "a"]
    m = fertility.measure(pa.array(texts), path)
    for i, t in enumerate(texts):
        assert (m["chars_per_token"][i], m["fallback_share"][i], m["entropy"][i]) == pytest.approx(brute_measure(t, tokens.vocabulary(path)))


def test_fertility_bands(spark):
    rng = np.random.default_rng(2)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company".split()
    v = tokens.vocabulary(fertility.VOCABULARIES["piece"])
    junk = next(j for j in ("!?#$%&*@" * k for k in range(1, 60)) if len(v.encode([j])[0]) >= 90)
    rows = [(i, " ".join(rng.choice(words, 90))) for i in range(80)] + [(900, junk), (901, None), (902, ""), (903, "short"), (None, " ".join(words * 3)), (1, " ".join(words * 3))]
    d = frame(spark, rows)
    d = d.unionByName(spark.createDataFrame([(950, "été " * 60, None, "", 1, 1, 1)], DOCS))
    r = {x["doc_id"]: x for x in fertility.fertility_report(d).collect()}
    assert not r[900]["accepted"] and all(r[i]["accepted"] for i in (2, 3, 901, 902, 903, 950)) and r[950]["lang"] == "und"
    kept = fertility.filter_fertility(d)
    assert kept.columns == d.columns and kept.count() == sum(x["accepted"] for x in fertility.fertility_report(d).collect())
    assert fertility.fertility_report(d.limit(0)).count() == fertility.filter_fertility(d.limit(0)).count() == 0


def brute_bands(rows):
    """Verdicts in plain Python: rows of (octave, lang, n_tokens, measures by name)."""
    def group(level, lang, o):
        for o2, l2, n, m in rows:
            if n >= fertility.MIN_TOKENS and (l2 == lang or level == 4) and (level == 3 or abs(o2 - o) <= (0, *fertility.WIDER, 0, 0)[level]):
                yield m

    def verdict(o, lang, n, m):
        if n < fertility.MIN_TOKENS:
            return True
        for level in range(5):
            own = list(group(level, lang, o))
            if len(own) >= fertility.MIN_GROUP:
                break
        else:
            return True
        for k, x in m.items():
            name = k.rsplit("_", 1)[0]
            if level == 4 and name != "entropy":
                continue
            v = sorted(y[k] for y in own)
            lo, hi = v[math.ceil(len(v) / 4) - 1], v[math.ceil(3 * len(v) / 4) - 1]
            wide = max(fertility.SPREAD * (hi - lo), fertility.FLOOR[name])
            if not lo - wide <= x <= hi + wide:
                return False
        return True

    return [verdict(*r) for r in rows]


def test_verdicts_against_brute_force(spark, sf_dir):
    """Measures, bands and verdicts of all documents of two sizes, recomputed text by text."""
    for at in (sf_dir, sf_dir.replace("0.001", "0.01")):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        rows, ids = [], []
        vs = {v: tokens.vocabulary(p) for v, p in fertility.VOCABULARIES.items()}
        for r in docs.collect():
            m, n = {}, None
            for v, voc in vs.items():
                n = len(voc.encode([r["text"] or ""])[0]) if n is None else n
                m |= {f"{k}_{v}": x for k, x in zip(fertility.MEASURES, brute_measure(r["text"], voc))}
            rows.append((int(math.log2(max(n, 1))), r["lang"] or "und", n, m))
            ids.append(r["doc_id"])
        got = {r["doc_id"]: r["accepted"] for r in fertility.fertility_report(docs).collect()}
        want = dict(zip(ids, brute_bands(rows)))
        assert got == want and not all(want.values())
        assert sorted(r["doc_id"] for r in fertility.filter_fertility(docs).collect()) == sorted(i for i, a in want.items() if a)


def test_fertility_of_clashing_columns_and_long_texts(spark):
    words = "time year people way day man thing woman life child world school state family".split()
    rng = np.random.default_rng(6)
    one = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, one(90), "en", "x", 1.5, 7, "c") for i in range(40)] + [(41, LONG, "en", "y", None, None, None), (41, LONG, None, "y", 0.1, 1, "d"), (None, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, octave string, entropy_piece double, c0 int, lo_entropy_piece string")
    kept = fertility.filter_fertility(d)
    ok = [r["accepted"] for r in fertility.fertility_report(d).collect()]
    assert kept.columns == d.columns and kept.count() == sum(ok) >= 41
    assert set(map(tuple, kept.collect())) <= set(rows)


def test_small_groups_take_wider_bands(spark):
    """Junk of a length or language of few documents is rejected, and what is like the rest there is kept."""
    rng = np.random.default_rng(3)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company".split()
    one = lambda n: " ".join(rng.choice(words, n))
    junk = "!?#$%&*@" * 2000
    rows = [(i, one(66 + i), "en") for i in range(50)] + [(100 + i, one(135), "en") for i in range(3)] + [(200 + i, one(90), "xx") for i in range(3)]
    rows += [(300, "time " * 180, "en"), (301, junk, "en"), (302, "time " * 90, "xx")]
    d = spark.createDataFrame([(i, t, lang, "", len(t), 1, 1) for i, t, lang in rows], DOCS)
    got = {r["doc_id"]: r["accepted"] for r in fertility.fertility_report(d).collect()}
    assert [i for i, a in got.items() if not a and i < 300] == [] and not any(got[i] for i in (300, 301, 302))
    assert sorted(r["doc_id"] for r in fertility.filter_fertility(d).collect()) == sorted(i for i, a in got.items() if a)


def test_rules_and_prefilter():
    assert len(RULES) >= 300 and len({r.rule_id for r in RULES}) == len(RULES)
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "see https://www.gnu.org/licenses/gpl-3.0.html",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "Copyright (c) 2019-2021 Someone. All rights reserved.", "veröffentlicht unter der GPLv3", "publié sous licence MIT", "nothing to see", "", None, "THE BSD 3-CLAUSE LICENSE", "mit jemandem reden", "dual-licensed under MIT license and the Apache License 2.0", "İ released\nunder the\nMIT   license",
    ]
    for t in texts:
        assert licenses.scan(t) == licenses.scan(t, prefilter=False), t
    got = [{RULES[r].license for r, _, _ in licenses.scan(t)} for t in texts]
    assert got[:4] == [{"Apache-2.0"}, {"MIT"}, {"GPL-3.0"}, {"CC-BY-NC-4.0"}] and got[10:13] == [set()] * 3 and got[14] == set()
    assert {"MIT", "Apache-2.0"} <= got[15] and got[16] == {"MIT"}


def matching(pattern, rng):
    """A random text that the expression matches, white space and case as the expression allows."""

    def one(kind, x):
        kind = str(kind)
        if kind == "LITERAL":
            c = chr(x)
            return str(rng.choice([c, c, c.upper(), *{"i": "İı", "s": "ſ", "k": "\u212a"}.get(c.lower(), "")]))
        if kind == "IN":
            return one(*x[int(rng.integers(0, len(x)))]) if str(x[0][0]) != "NEGATE" else "x"
        if kind == "CATEGORY":
            return {"SPACE": str(rng.choice([" ", "\n", "\r\n", "  ", "\t", "\u00a0", "\n  "])), "DIGIT": str(rng.integers(0, 10))}.get(str(x).split("_", 1)[1], "x")
        if kind == "RANGE":
            return chr(int(rng.integers(x[0], x[1] + 1)))
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            return "".join(every(x[2]) for _ in range(int(rng.integers(x[0], min(int(x[1]), x[0] + 2) + 1))))
        if kind == "BRANCH":
            return every(x[1][int(rng.integers(0, len(x[1])))])
        if kind == "SUBPATTERN":
            return every(x[3])
        return {"ANY": " ", "AT": "", "ASSERT_NOT": ""}[kind]

    def every(p):
        return "".join(one(k, x) for k, x in p)

    parsed = re._parser.parse(pattern, re.IGNORECASE)
    texts = (every(parsed) for _ in range(1000))
    return next(t for t in texts if re.fullmatch(pattern, t, re.IGNORECASE))


def test_prefilter_over_white_space():
    """Keywords broken over lines, or with several blanks, open their rules, as running all expressions finds."""
    t = "This file is distributed\nunder the GNU General\nPublic   License, version 3"
    assert [RULES[r].license for r, _, _ in licenses.scan(t)] == ["GPL-3.0"] == [RULES[r].license for r, _, _ in licenses.scan(t, prefilter=False)]
    assert licenses.scan(" \n ") == []
    rng = np.random.default_rng(9)
    for r in RULES:
        if r.license != "Copyright":
            for broken in ("\n", "  ", None):
                t = matching(r.pattern, rng)
                t = t if broken is None else re.sub(r"\s+", broken, t)
                assert licenses.scan(t) == licenses.scan(t, prefilter=False), (r, t)


def test_matches_contain_keywords():
    for t in ("© 2021 Acme", "(c) 2020", "(C) 2020-2023 Acme", "©1999", "Copyright 2020"):
        assert licenses.scan(t) == licenses.scan(t, prefilter=False) != [], t
    rng = np.random.default_rng(10)
    for r in RULES:
        for t in (matching(r.pattern, rng) for _ in range(6)):
            assert any(w in licenses._plain(t) for w in r.keywords), (r, t)


def test_suppression_against_brute_force():
    rng = np.random.default_rng(4)
    rules = tuple(RULES)
    for _ in range(100):
        found = [(int(rng.integers(0, len(rules))), s := int(rng.integers(0, 30)), s + int(rng.integers(1, 12))) for _ in range(12)]
        kept = licenses.resolve(found, rules)
        for f in set(found):
            inside = [k for k in kept if k != f and k[1] <= f[1] and f[2] <= k[2]]
            if f in kept:
                assert not any(rules[k[0]].priority > rules[f[0]].priority or (k[1], k[2]) == (f[1], f[2]) for k in inside)
            else:
                assert any(rules[k[0]].priority >= rules[f[0]].priority for k in inside)


def plain_resolve(found, rules):
    kept = []
    for r, s, e in sorted(set(found), key=lambda x: (-rules[x[0]].priority, x[1] - x[2], x[1], x[0])):
        if not any(a <= s and e <= b for _, a, b in kept):
            kept.append((r, s, e))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def test_suppression_of_many_detections():
    rng = np.random.default_rng(5)
    rules = tuple(RULES)
    for n, wide in ((0, 9), (1, 9), (300, 40), (300, 4000)):
        found = [(int(rng.integers(0, len(rules))), s := int(rng.integers(0, wide)), s + int(rng.integers(1, 30))) for _ in range(n)]
        assert licenses.resolve(found, rules) == plain_resolve(found, rules)
    many = [(k % len(rules), 40 * k, 40 * k + 30 + k % 7) for k in range(50_000)]
    began = time.perf_counter()
    assert len(licenses.resolve(many, rules)) == 50_000 and time.perf_counter() - began < 3


def test_license_detections(spark):
    rows = [(1, "Released under the MIT License."), (None, "Released under the MIT License."), (2, None), (3, ""), (1, "Released under the MIT License."), (4, "x " * 50_000 + "Licensed under CC BY-NC 4.0.")]
    got = licenses.license_detections(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (4, "CC-BY-NC-4.0")]
    assert all(r["matched"] and r["end"] - r["start"] == len(r["matched"]) for r in got)
    assert licenses.license_detections(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op2_host_reputation", "op3_ngram_jaccard_join", "op8_pfair_mixing"])
def test_query_equals_sql(spark, sf_dir, name):
    from lodestack.llm.queries import ORACLES, QUERIES

    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(ORACLES[name], sf_dir)


def test_pairs_equal_sql(spark, sf_dir):
    assert rows_of(J.jaccard_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == rows_of_sql(J.ORACLE_SQL, sf_dir)


def test_reputation_edges(spark):
    urls = [(1, "http://a.x.com/1"), (2, "http://a.x.com/2"), (3, "https://b.x.com:8080/"), (4, "HTTP://U:p@B.X.COM./q"), (5, None), (6, "no url"), (7, "http://10.0.0.1/z"), (8, "http://w.co.uk/"), (9, "http://co.uk/"), (None, "http://a.x.com/"), (1, "http://a.x.com/1"), (10, "http://localhost/")]
    p = spark.createDataFrame([(i, u, "s", 0) for i, u in urls], "page_id long, url string, host string, n int")
    o = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (4, None), (6, 0), (7, 0)], "page_id long, good int")
    got = sorted((tuple(r) for r in url_reputation.host_reputation(p, o).collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    by = {r[0]: r for r in got}
    assert len(got) == 12 and by[4][1:4] == ("b.x.com", "x.com", "com") and by[8][2:4] == ("w.co.uk", "co.uk") and by[7][1:4] == ("10.0.0.1", "10.0.0.1", "ip") and by[10][2] == "localhost"
    assert by[5][1] is None and by[6][1] is None and by[5][6] == by[6][6] and by[1][4:6] == (3, 2)
    assert all(0 < r[6] < 1 and r[7] < r[6] for r in got)
    assert url_reputation.host_reputation(p.limit(0), o).count() == 0
    none = url_reputation.host_reputation(p, o.limit(0)).collect()
    assert len(none) == 12 and {r["posterior_mean"] for r in none} == {0.5}


def plain_suffix(host, rules):
    """The public suffix algorithm as published, over all rules."""
    labels, best, exception = host.split("."), (0, 0), None
    for r in rules:
        own = r.lstrip("!").split(".")
        if len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own, labels[-len(own) :])):
            if r.startswith("!"):
                exception = len(own) - 1
            best = max(best, (len(own), 0))
    return ".".join(labels[-(exception or best[0] or 1) :])


def test_public_suffixes(spark):
    rules = url_reputation.public_suffixes()
    assert len(rules) > 9000
    hosts = ["a.example.edu.au", "edu.au", "example.edu.au", "x.y.com", "com", "www.ck", "a.www.ck", "b.ck", "a.b.ck", "ck", "city.kobe.jp", "a.city.kobe.jp", "x.kobe.jp", "a.x.kobe.jp", "me.github.io", "a.me.github.io", "no-such-tld", "a.no-such-tld", "b.c.no-such-tld", "a.com.pl", "gov.au", "s3.amazonaws.com", "b.s3.amazonaws.com", "xn--55qx5d.cn", "a.xn--55qx5d.cn", "x.公司.cn", "ide.kyoto.jp", "k.ide.kyoto.jp"]
    rng = np.random.default_rng(1)
    for r in rng.choice(rules, 400).tolist():
        hosts += [x for x in (r.replace("*", "w").lstrip("!"), "a." + r.replace("*", "w").lstrip("!"), "b.a." + r.replace("*", "w").lstrip("!"))]
    got = {r["host"]: r for r in url_reputation.with_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), rules).collect()}
    for h in hosts:
        s = plain_suffix(h, rules)
        assert got[h]["suffix"] == s and got[h]["domain"] == ".".join(h.split(".")[-(s.count(".") + 2) :]), h


def test_beta_quantile():
    rng = np.random.default_rng(0)
    for a, b in ((1.0, 1.0), (2.0, 3.0), (0.3, 0.7), (50.0, 2.0), (400.0, 600.0), (90_000.0, 10_000.0), (3.0, 0.02)):
        got = float(url_reputation.beta_quantile(0.05, np.array([a]), np.array([b]))[0])
        assert 0 <= got <= 1 and abs((rng.beta(a, b, 200_000) <= got).mean() - 0.05) < 0.003
    assert url_reputation.beta_quantile(0.05, np.array([0.05]), np.array([3.0]))[0] < 1e-12  # a bound of rare outcomes isn't below 0
    assert url_reputation.beta_quantile(0.05, np.array([1.0]), np.array([1.0]))[0] == pytest.approx(0.05)
    assert url_reputation.beta_quantile(0.05, np.array([4.0]), np.array([1.0]))[0] == pytest.approx(0.05 ** (1 / 4))


def test_reputation_by_url_and_long_urls(spark):
    long = "http://h.example.com/" + "x" * 1_000_000
    p = spark.createDataFrame([(1, long, "a"), (2, "http://h.example.com/2", "b"), (3, None, "c")], "page_id long, url string, suffix string")
    by_url = spark.createDataFrame([(long, 1), ("http://h.example.com/2", 1), (None, 0), ("http://h.example.com/", None)], "url string, good int")
    by_id = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "page_id long, good int")
    a, b = (sorted(map(tuple, url_reputation.host_reputation(p, o).collect())) for o in (by_url, by_id))
    assert a == b and a[0][1:6] == ("h.example.com", "example.com", "com", 2, 2) and a[2][4] == 0


def test_filters_hold_planted_cases(spark, sf_dir):
    """Copies with one word changed are found, and texts that share one passage of 60 words are left alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars between 2000 and 8000 and lang = 'en'").limit(20).collect()
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(10_000 + i, re.sub(r" \w+ ", " changed ", t, count=1)) for i, t in rows]
    rows += [(20_000 + i, passage + " " + " ".join(f"own{i}x{k}" for k in range(100))) for i in range(10)]
    pairs = {(a, b) for a, b, _ in J.jaccard_pairs(frame(spark, rows)).collect()}
    assert all((min(r["doc_id"], 10_000 + r["doc_id"]), 10_000 + r["doc_id"]) in pairs for r in docs)
    assert not any(a >= 20_000 for a, _ in pairs)


def test_materialized_tables_are_swept(spark):
    import os

    C.sweep(spark)
    d = C.materialize(spark.range(5))
    path = d.inputFiles()[0].removeprefix("file://")
    assert d.count() == 5 and os.path.exists(path)
    assert C.sweep(spark) == 1 and not os.path.exists(path) and C.sweep(spark) == 0


def test_measured_bytes(spark):
    d = spark.createDataFrame([("abc", 1, ["x"]), (None, 2, None), ("ñ", None, [])], "`a.b` string, n long, l array<string>")
    assert C.measured(d)[0] == 3 and C.measured(d.select("`a.b`", "n")) == (3, 3 + 2 + 3 * 12) and C.measured(d.limit(0)) == (0, 0)
    assert C.measured(d.repartition(3)) == C.measured(d)
