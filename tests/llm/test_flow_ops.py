"""HTML, packing, mixing, sharding and the pipeline."""

import re
from fractions import Fraction

import numpy as np
import pytest

from lodestack.llm import html_content as H
from lodestack.llm import mixing, packing, sharding

DOCS = "doc_id long, text string, source string, slot long, shard int"


def frame(spark, n=50, sources=3):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(i, "word " * int(rng.integers(0, 60)) + "end", f"s{i % sources}", 7, 8) for i in range(n)], DOCS)


# ---- html


def brute_marginals(parent, score, pair, edge):
    n, total, hit = len(parent), 0.0, np.zeros(len(parent))
    for k in range(1 << n):
        y = [(k >> i) & 1 for i in range(n)]
        p = np.exp(sum(s * v for s, v in zip(score, y)) + sum(pair[edge[i], y[parent[i]], y[i]] for i in range(n) if parent[i] >= 0))
        total += p
        hit += p * np.array(y)
    return hit / total


def test_sum_product_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pages = []
        for _ in range(3):
            p = H.Page()
            for i in range(1, 8):
                p.tag.append(str(rng.choice(["p", "a", "div"])))
                p.parent.append(int(rng.integers(0, i)))
                p.attr.append("")
            pages.append(p)
        f = H.Forest(pages)
        score, pair = rng.normal(0, 1.5, len(f.tags)), rng.normal(0, 1, (2, 2, 2))
        mu, joint = H.sum_product(f, score, pair)
        for k in range(3):
            s = slice(f.base[k], f.base[k + 1])
            want = brute_marginals([x - f.base[k] if x >= 0 else -1 for x in f.parent[s]], score[s], pair, f.edge[s])
            np.testing.assert_allclose(mu[s], want, atol=1e-9)
        child = np.flatnonzero(f.parent >= 0)
        np.testing.assert_allclose(joint[child][:, :, 1].sum(1), mu[child], atol=1e-9)
        np.testing.assert_allclose(joint[child][:, 1, :].sum(1), mu[f.parent[child]], atol=1e-9)


def test_training_gradient():
    pages = [H.parse(f"<body><nav><a href=x>link{i}</a></nav><article><p>some text, of a page {i}.</p><div>more</div></article></body>") for i in range(6)]
    m = H.train(pages)
    f = H.Forest(pages)
    assert (((m.marginals(f) >= 0.5) == H.landmark_labels(f)) | (f.under == 0)).all()


@pytest.mark.parametrize(
    "html,texts",
    [
        ("<p>a<p>b<ul><li>c<li>d</ul>", ["a", "b", "c", "d"]), ("<!-- <p>no</p> --><b>x</b>", ["x"]), ("<script>var a='<p>';</script>y", ["y"]), ("a &amp; b", ["a & b"]), ("<p>open", ["open"]), ("</p></div>z", ["z"]), ("", []), (None, []), ("<", ["<"]), ("<p a='>'>q</p>", ["q"]), ("<script>never closed", []), ("<br/>t<img src=x>u", ["t", "u"]),
        ("<a b='c>d", ["d"]), ("<a b=\">x</a><i c='>'>y", ["x", "'>y"]), ("a<b", ["a<b"]), ("<td>a<table><span><td>b</td>c", ["a", "b", "c"]), ("<!-- open", []), ("<![CDATA[<p>]]>", ["<p>"]), ("</b></b>z", ["z"]), ("<?php a?>b", ["b"]), ("1 < 2 > 3", ["1 < 2 > 3"]),
    ],
)
def test_parser(html, texts):
    assert [t for _, t in H.parse(html).seg] == texts


BROKEN = {"never ended": "<a " * 350_000, "stray ends": "<i>" * 150_000 + "</b>" * 150_000, "nested": "<span>" * 170_000, "stray quotes": '<a " ' * 200_000 + ">", "quotes across": '<a ">" ' * 140_001, "cells": "<td><table>" + "<span>" * 70_000 + "<td></td>" * 60_000, "blanks": " " * 1_000_000, "comments": "<!-- " * 200_000, "pairs": "<a " + "''" * 400_000 + '" >', "paragraphs": "<p>" * 300_000}


@pytest.mark.parametrize("kind", BROKEN)
def test_parsing_is_linear(kind):
    import time

    began = time.perf_counter()
    H.parse(BROKEN[kind])
    assert time.perf_counter() - began < 8  # quadratic time would be hours


def test_deep_page_is_extracted():
    m = H.train([H.parse("<nav><a>x</a></nav><article><p>long text here, indeed.</p></article>")] * 3)
    f = H.Forest([H.parse("<span>t " * 20_000), H.parse("<p>a  \n  b<p>" + " \n" * 300_000 + "c")])
    mu = m.marginals(f)
    (text, n, _, _), (short, _, _, _) = H.content(f, mu, 0.0)
    assert n == 20_000 and text.count("t") == 20_000 and short == "a\nb\nc"
    np.testing.assert_allclose(mu, H.sum_product(f, f.x @ m.w, m.pair)[0])


def test_extraction_against_enumeration(spark):
    """Text, counts and confidence of small pages, from marginals by enumeration of all labelings."""
    small = ["<p>one, two.</p><ul><li><a>x</a><li>y</ul>", "<div><b>bold</b> plain<p>more text here.</p></div>", "bare", "<nav><a>home</a></nav><p>a<span>b</span>c</p>", "<table><tr><td>1<td>2</table>"]
    m = H.train([H.parse(f"<nav><a href=x>link{i}</a></nav><article><p>some text, of a page {i}.</p></article>") for i in range(5)])
    d = spark.createDataFrame([(i, h) for i, h in enumerate(small)], "page_id long, html string")
    for r in H.extract_content(d, m).collect():
        f = H.Forest([p := H.parse(small[r["page_id"]])])
        mu = brute_marginals(f.parent.tolist(), f.x @ m.w, m.pair, f.edge)
        own = [(e, t) for e, t in p.seg if mu[e] >= 0.5]
        assert (r["n_elements"], r["n_content"]) == (len(p.tag) - 1, len({e for e, _ in own}))
        assert r["confidence"] == pytest.approx(sum(mu[e] * len(t) for e, t in own) / max(1, sum(len(t) for _, t in own)), abs=1e-6)
        assert re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", "".join(t for _, t in own))


def test_extraction_held_out(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()}
    m = H.train_on(pages.where("page_id % 2 = 0"), train_pages=100)
    test = pages.where("page_id % 2 = 1")
    bare = test.withColumn("html", __import__("pyspark").sql.functions.regexp_replace("html", "(?i)</?article>", ""))  # no landmarks
    score = []
    for d in (test, bare):
        f1 = []
        for r in H.extract_content(d, m).join(test.select("page_id", "url"), "page_id").collect():
            k = re.search(r"/(\d+)(?:\.html|/)?(?:[?#].*)?$", r["url"])
            a, b = set(re.findall(r"\w+", docs[int(k[1])])), set(re.findall(r"\w+", r["text"]))
            f1.append(2 * len(a & b) / max(1, len(a) + len(b)))
        score.append(np.mean(f1))
    assert score[0] > 0.97 and score[1] > 0.9


def test_extraction_edges(spark):
    m = H.train([H.parse("<nav><a>x</a></nav><article><p>long text here, indeed.</p></article>")] * 3)
    rows = [(1, None, "t"), (2, "", "t"), (None, "<p>hi</p>", "t"), (3, "<div>" * 3000 + "deep", "t"), (3, "<p>" + "w " * 200_000, "t")]
    got = H.extract_content(spark.createDataFrame(rows, "page_id long, html string, text string"), m).collect()
    assert len(got) == 5 and got[0]["text"] == got[1]["text"] == "" and got[0]["n_elements"] == 0
    assert H.extract_content(spark.createDataFrame([], "page_id long, html string"), m).count() == 0
    assert H.train([]).w.sum() == 0


# ---- packing


def brute_pack(lengths, size):
    """Try every level, recount the squares, take the fullest of the best."""
    level, where = {}, []
    for s in lengths:
        best = None
        counts = np.bincount([v for v in level.values() if 0 < v < size], minlength=size + 1)
        for h in sorted({0, *(v for v in level.values() if v < size)}):
            if h + s > size:
                continue
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + s < size:
                c[h + s] += 1
            key = (int((c * c).sum()), -h)
            best = min(best, (key, h)) if best else (key, h)
        where.append(best[1])
        w = next((k for k, v in level.items() if v == best[1]), None) if best[1] else None
        w = len(level) if w is None else w
        level[w] = best[1] + s
    return where, len(level)


def test_rows_without_id_spread_over_shards(spark):
    d = frame(spark, 300).selectExpr("cast(null as long) as doc_id", "concat(text, ' ', doc_id) as text")
    rows = packing.pack_documents(d, window=64, docs_per_shard=30).collect()
    assert len(rows) >= 300 and len({r["window_id"] >> 40 for r in rows}) >= 5


def test_placement_against_brute_force():
    rng = np.random.default_rng(2)
    for size in (7, 16, 40):
        lengths = rng.integers(1, size, 300)
        p = packing.Packer(size)
        got = [p.place(int(s))[1] for s in lengths]
        assert (got, p.windows) == brute_pack(lengths.tolist(), size)


@pytest.mark.parametrize("window", [16, 64])
def test_packing_is_a_partition(spark, window):
    d = frame(spark, 60)
    d = d.unionByName(spark.createDataFrame([(None, "a b c", "s", 1, 1), (100, None, "s", 1, 1), (101, "", "s", 1, 1), (102, "long " * 500, "s", 1, 1), (5, "again", "s", 1, 1), (5, "again", "s", 1, 1)], DOCS))
    rows = packing.pack_documents(d, window=window, docs_per_shard=20).collect()
    used = {}
    for r in rows:
        if r["window_id"] is None:
            assert r["n_tokens"] == 0
            continue
        span = range(r["window_start"], r["window_start"] + r["n_tokens"])
        assert span.stop <= window and not used.setdefault(r["window_id"], set()) & set(span)
        used[r["window_id"]] |= set(span)
    assert sorted({r["doc_id"] for r in rows if r["window_id"] is None}) == [100, 101]
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 102) == 501 or sum(r["n_tokens"] for r in rows if r["doc_id"] == 102) >= 500
    assert len([r for r in rows if r["doc_id"] == 5]) >= 3
    assert all(s == set(range(len(s))) for s in used.values())  # no holes
    assert packing.pack_documents(d.limit(0)).count() == 0


# ---- mixing


@pytest.mark.parametrize("weights", [[1, 1], [9, 1], [500_000, 300_000, 200_000], [1, 2, 3, 4, 5, 6, 7], [10] + [1] * 30])
def test_deviation_stays_below_one_block(weights):
    total, got = sum(weights), [0] * len(weights)
    for t, s in zip(range(1, 3000), mixing.pfair_phase(weights)):
        got[s] += 1
        assert all(abs(g - Fraction(w * t, total)) < 1 for g, w in zip(got, weights))


def test_schedule_uses_every_block_once():
    blocks, weights = [5, 0, 17, 3], [1, 4, 2, 0]
    rows = list(mixing.schedule(blocks, weights))
    assert [r[0] for r in rows] == list(range(25)) and sorted((s, b) for _, _, s, b in rows) == [(s, b) for s, n in enumerate(blocks) for b in range(n)]
    assert all(s != 3 for _, _, s, _ in rows[:22])
    assert list(mixing.schedule([], [])) == []


def plain_schedule(blocks, weights):
    """Slot after slot, without periods."""
    used, slot, phase = [0] * len(blocks), 0, 0
    while any(u < b for u, b in zip(used, blocks)):
        live = [s for s, b in enumerate(blocks) if used[s] < b and weights[s]] or [s for s, b in enumerate(blocks) if used[s] < b]
        for k in mixing.pfair_phase([weights[s] or 1 for s in live]):
            s = live[k]
            yield slot, phase, s, used[s]
            slot, used[s] = slot + 1, used[s] + 1
            if used[s] == blocks[s]:
                break
        phase += 1


def test_periods_give_the_plain_schedule():
    rng = np.random.default_rng(8)
    cases = [([], []), ([0], [1]), ([3], [0]), ([5, 5], [1, 1]), ([100, 3, 40], [2, 1, 1]), ([200, 200, 200], [7, 2, 3]), ([40, 50, 60], [600_000, 300_000, 100_000]), ([4, 5, 6], [0, 0, 0])]
    cases += [(rng.integers(0, 90, k).tolist(), rng.integers(0, 12, k).tolist()) for k in (2, 3, 5, 8) for _ in range(10)]
    for blocks, weights in cases:
        assert list(mixing.schedule(blocks, weights)) == list(plain_schedule(blocks, weights)), (blocks, weights)


def test_long_phases_cost_one_period():
    big = [10**9, 3 * 10**9, 10**7]
    plan = list(mixing.phases(big, [300_000, 600_000, 100_000]))
    assert sum(len(a) for p in plan for a in p.at.values()) <= 3 * 1_000_000 and {s: e for p in plan for s, e in p.end.items()} == dict(enumerate(big))


@pytest.mark.parametrize("limit", [0, mixing.BROADCAST_SLOTS])
def test_slots_by_either_join(spark, limit):
    blocks, weights = [70, 20, 31], [5, 2, 1]
    rows = [("abc"[s], b) for s, n in enumerate(blocks) for b in range(n)]
    d = mixing._slots(spark.createDataFrame(rows, "s string, block long"), list(mixing.phases(blocks, weights)), list("abc"), limit)
    assert sorted((r["slot"], r["phase"], "abc".index(r["s"]), r["block"]) for r in d.collect()) == list(plain_schedule(blocks, weights))


NAMES = ["__h", "__b", "__s", "__i", "h1", "b", "row", "s", "i", "id", "tie", "c0", "k", "place", "slot", "a.b"]


def clashing(spark, n=60):
    rows = [(i % 50, f"s{i % 3}", "text", *(f"{c}{i}" for c in NAMES)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


def test_columns_that_clash_with_inner_names(spark):
    rows, d = clashing(spark)
    mixed = mixing.mixed_documents(d, block_docs=4)
    assert mixed.columns == d.columns and sorted(map(tuple, mixed.collect())) == sorted(rows)
    kept = mixing.mix_sources(d, block_docs=4, keep=("__h", "s", "place", "a.b"))
    assert kept.columns == ["__h", "s", "a.b", "slot", "phase", "block", "place"] and sorted(r[:3] for r in map(tuple, kept.collect())) == sorted((r[3], r[10], r[-1]) for r in rows)
    shuffled = sharding.external_shuffle(d, buckets=4)
    assert shuffled.columns == [*d.columns, "shard", "position"] and sorted(tuple(r)[:-2] for r in shuffled.collect()) == sorted(rows)


def test_mix(spark):
    d = frame(spark, 200, 4)
    d = d.unionByName(spark.createDataFrame([(None, "x", None, 1, 1), (3, "x", None, 1, 1), (3, "x", "s0", 1, 1)], DOCS))
    got = mixing.mix_sources(d, block_docs=8).collect()
    assert len(got) == 203 and len({(r["slot"], r["place"]) for r in got}) == 203
    by = {}
    for r in got:
        by.setdefault(r["slot"], set()).add((r["source"], r["block"], r["phase"]))
    assert all(len(v) == 1 for v in by.values()) and sorted(by) == list(range(len(by)))
    named = mixing.mix_sources(d, block_docs=8, weights={"s1": 0.75, "s2": 0.25}).collect()
    first = [next(r["source"] for r in named if r["slot"] == k) for k in range(8)]
    assert first.count("s1") == 6 and first.count("s2") == 2
    assert mixing.mix_sources(d.limit(0)).count() == 0
    rows = mixing.mixed_documents(d, block_docs=8)
    assert rows.columns == d.columns
    order = [(r["doc_id"], r["source"]) for r in rows.collect()]
    assert order == [(r["doc_id"], r["source"]) for r in sorted(got, key=lambda r: (r["slot"], r["place"]))]


# ---- sharding


def test_shuffle(spark):
    d = frame(spark, 120).unionByName(spark.createDataFrame([(None, None, None, None, None)] * 3 + [(7, "x", "y", 1, 1)] * 2, DOCS))
    got = sharding.external_shuffle(d, buckets=5).collect()
    assert sorted(((r["doc_id"], r["text"], r["source"], r["slot"]) for r in got), key=str) == sorted(((r["doc_id"], r["text"], r["source"], r["slot"]) for r in d.collect()), key=str)
    for b in {r["shard"] for r in got}:
        own = sorted(r["position"] for r in got if r["shard"] == b)
        assert own == list(range(len(own)))
    again = sharding.external_shuffle(d.repartition(3), buckets=5).collect()
    key = lambda r: (r["shard"], r["position"])
    assert [tuple(r) for r in sorted(again, key=key)] == [tuple(r) for r in sorted(got, key=key)]
    other = sharding.external_shuffle(d, buckets=5, seed=1).collect()
    assert [r["doc_id"] for r in sorted(other, key=key)] != [r["doc_id"] for r in sorted(got, key=key)]
    assert sharding.external_shuffle(d.limit(0)).count() == 0
    assert sharding.external_shuffle(d).columns == ["doc_id", "text", "source", "slot", "shard", "position"]


def key_order(rows):
    return [tuple(r) for r in sorted(rows, key=lambda r: (r["shard"], r["position"]))]


def test_repeated_records_scatter_uniformly(spark):
    from pyspark.sql import functions as F

    d = spark.range(10_000).select(F.lit(1).alias("a"), F.lit("same").alias("t")).unionByName(spark.range(3_000).select(F.col("id").cast("int").alias("a"), F.lit("own").alias("t")))
    got = sharding.external_shuffle(d, buckets=16).collect()
    for t, n in (("same", 10_000), ("own", 3_000)):
        c = np.bincount([r["shard"] for r in got if r["t"] == t], minlength=16)
        assert c.sum() == n and ((c - n / 16) ** 2 / (n / 16)).sum() < 45  # chi-square, 15 degrees
    at = np.array([r["position"] for r in sorted(got, key=lambda r: (r["shard"], r["position"])) if r["t"] == "own" and r["shard"] == 0])
    assert abs(at.mean() / np.bincount([r["shard"] for r in got])[0] - 0.5) < 0.1  # mixed among the equal ones


def plain_shuffle(rows, seed, buckets, hashes):
    """Bucket by bucket in plain Python, from the hashes of (record, number among its equals)."""
    out = {}
    for r, (h1, h2, k, b) in zip(rows, hashes):
        out.setdefault(b, []).append((h1, h2, k, r))
    return [(*x[3], b, i) for b in sorted(out) for i, x in enumerate([sorted(out[b])[j] for j in sharding.fisher_yates(len(out[b]), seed, b)])]


def test_shuffle_against_brute_force(spark):
    from pyspark.sql import functions as F

    rows = sorted([(i, f"t{i}") for i in range(40)] + [(5, "t5")] * 6 + [(7, "t7")])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    h = spark.createDataFrame([(*r, rows[:i].count(r)) for i, r in enumerate(rows)], "doc_id long, text string, k long").withColumns({"h1": F.xxhash64(F.lit(3), "doc_id", "text"), "h2": F.xxhash64(F.lit(~3), "doc_id", "text")})
    h = h.withColumn("b", F.pmod(F.xxhash64(F.lit(3), "h1", "h2", "k"), F.lit(5)).cast("int")).select("h1", "h2", "k", "b", "doc_id", "text").collect()
    want = plain_shuffle([tuple(r)[4:] for r in h], 3, 5, [tuple(r)[:4] for r in h])
    assert key_order(sharding.external_shuffle(d, seed=3, buckets=5).collect()) == want


def test_shards_do_not_hang_on_the_layout(spark, tmp_path, monkeypatch):
    d = frame(spark, 300).unionByName(frame(spark, 40)).unionByName(spark.createDataFrame([(9, "long " * 100_000, None, 0, 0), (9, "long " * 100_000, None, 0, 0), (10, "", "", 0, 0)], DOCS))
    d.coalesce(1).write.parquet(f"{tmp_path}/one")
    d.orderBy("text").repartition(7).write.parquet(f"{tmp_path}/seven")
    a, b = (key_order(sharding.external_shuffle(spark.read.parquet(f"{tmp_path}/{x}"), bucket_bytes=1 << 17).collect()) for x in ("one", "seven"))
    assert a == b and len(a) == 343 and len({r[-2] for r in a}) > 3
    monkeypatch.setattr(sharding.C, "BROADCAST_ROWS", 0)  # too many repeated records to look up
    monkeypatch.setattr(sharding, "COPIES", 2)
    assert key_order(sharding.external_shuffle(spark.read.parquet(f"{tmp_path}/one"), bucket_bytes=1 << 17).collect()) == a


def test_shuffle_of_maps_and_zeros(spark):
    d = spark.sql("SELECT map('a', id) AS m, if(id % 2 = 0, 0.0D, -0.0D) AS z, array(id % 2) AS l FROM range(4)")
    got = sharding.external_shuffle(d.unionAll(d), buckets=2).collect()
    assert sorted(str((r["m"], r["z"], r["l"])) for r in got) == sorted(str((r["m"], r["z"], r["l"])) for r in d.unionAll(d).collect())


def test_write_shards(spark, tmp_path):
    sharding.write_shards(frame(spark, 40), f"{tmp_path}/out", buckets=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 40 and back.select("shard").distinct().count() == 4


def test_fisher_yates_is_uniform():
    n = 24_000
    count = {}
    for b in range(n):
        count[tuple(sharding.fisher_yates(4, 3, b).tolist())] = count.get(tuple(sharding.fisher_yates(4, 3, b).tolist()), 0) + 1
    assert len(count) == 24 and sum((c - n / 24) ** 2 / (n / 24) for c in count.values()) < 50  # chi-square, 23 degrees


# ---- pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P
    from lodestack.llm import fertility, nbsvm
    from lodestack.llm import ngram_join as J
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "quality rules", "near duplicates", "mix", "pack"]
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = [docs]
    for k, (_, fn) in enumerate(P.STAGES):
        fn(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen[:5]]
    assert all(d.columns == docs.columns for d in seen[:5])
    ok = {r["doc_id"] for r in nbsvm.score_quality(docs, nbsvm.train(docs, lab)).where("accepted").collect()}
    assert ids[1] == sorted(ok)
    assert ids[2] == sorted(r["doc_id"] for r in fertility.fertility_report(seen[1]).where("accepted").collect())
    root = {}
    pairs = J.jaccard_pairs(seen[2]).collect()

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for r in pairs:
        a, b = find(r["doc_a"]), find(r["doc_b"])
        root[max(a, b)] = min(a, b)
    assert ids[3] == [i for i in ids[2] if find(i) == i]
    assert ids[4] == ids[3]
    order = [r["doc_id"] for r in seen[4].orderBy(F.col("_metadata.file_name"), F.col("_metadata.row_index")).collect()]
    m = mixing.mix_sources(seen[3]).orderBy("slot", "place").collect()
    assert order == [r["doc_id"] for r in m]
    assert {r["doc_id"] for r in seen[5].select("doc_id").collect()} == set(ids[4])
    assert sorted(map(tuple, P.run(spark, sf_dir).collect()), key=str) == sorted(map(tuple, seen[5].collect()), key=str)


def test_pipeline_deletes_what_it_has_used(spark, sf_dir):
    import corpus_pipeline as P
    from lodestack.llm import common as C

    other = C.materialize(spark.range(3))
    n = len(C.made())
    assert P.run(spark, sf_dir).count() > 0 and other.count() == 3
    assert len(C.made()) <= n + 3  # the mix, and what packing reads


def test_stages_of_long_repeated_and_widened_rows(spark, sf_dir):
    """Extra columns keep their values under any name; repeated rows stay together; a very long text passes whole."""
    import corpus_pipeline as P
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = spark.createDataFrame([(10**9, " ".join(f"word{i % 977} and{i % 89}" for i in range(60_000)), "en", "s1", 5)], docs.schema)
    names = ["lang_1", "octave", "c0", "s", "row", "slot", "__gone", "n_tokens_piece"]
    d = docs.unionByName(docs.limit(5)).unionByName(long).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for c in names})
    for name, fn in P.STAGES[:-1]:
        kept = fn(spark, d, sf_dir)
        assert kept.columns == d.columns, name
        rows = kept.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
        assert [len(r["text"]) for r in rows if r["doc_id"] == 10**9] in ([], [long.first()["text"].__len__()])
        if name == "mix":
            assert len(rows) == d.count()
    got = P.STAGES[-1][1](spark, d, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in d.select("doc_id").distinct().collect()} and next(r["n"] for r in got if r["doc_id"] == 10**9) > 100_000


def test_pipeline_of_empty_and_odd_tables(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "x", None, None, 1)], docs.schema)
    for d, n in ((docs.limit(0), 0), (odd, 3)):
        for k, (_, fn) in enumerate(P.STAGES):
            assert fn(spark, d, sf_dir).count() == n
