"""Exact n-gram Jaccard self-join by adaptive multi-match prefixes.

Each document is the set of its word n-grams, ordered from rare to frequent by document frequency counted over
the whole corpus. If two sets overlap by at least o, their prefixes of length |x| - o + m share at least m tokens,
for every m. Each document picks its own m: the prefix grows while the estimated cost (postings to scan plus
candidates to verify) falls, and a pair is verified only when it shares min(m_a, m_b) prefix tokens.

N-grams of frequency one match nothing and come first in the order, so they fill prefixes without being indexed;
a document of which fewer than t|x| n-grams recur has no partner and leaves at once. Documents with equal sets
enter the join once, by their smallest id, and are expanded at the end. All counts, prefixes and comparisons
cover every document and every n-gram; there are no caps.

Postings and candidates of one group of copies meet in one bucket; where a bucket has too much work for a task, its
documents are divided into r parts, and each pair of parts is a task of its own. For groups alone, documents are first
linked to one likely partner each; what these links connect isn't compared again, so that a large group costs in
proportion to its size. All links of a document lie within its group, so their number is counted there, by overlaps of
blocks of documents as matrix products, without a row for any pair.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

U = np.uint64
TOKENS_A_BUCKET = 1_500_000
DOCS_A_BUCKET = 8_000
PAIRS_A_BUCKET = 24_000
POSTINGS_A_BUCKET = 150_000
#: Rows whose n-grams one worker holds at a time, and partner slots it expands at a time.
ROWS_AT_ONCE = 1_000
SLOTS_AT_ONCE = 1_000_000
#: Partner slots, by estimate, and candidates, that one task of a bucket takes before the bucket is divided.
SLOTS_A_TASK = 40_000_000
PAIRS_A_TASK = 96_000
#: n-grams of the documents that one such task holds, about.
TOKENS_A_TASK = 1_500_000
#: Tokens of partners that one document is compared with at a time.
TOKENS_AT_ONCE = 500_000
#: Documents of a group that are counted against each other at a time, n-grams that one matrix product spans, and for an
#: n-gram the share of its blocks' pairs, as one in so many, from which it enters that product.
DOCS_A_BLOCK = 2_000
NGRAMS_A_PRODUCT = 2_048
DENSE = 128
#: Rows of a block whose similarities are held at a time.
ROWS_A_BLOCK = 256
#: Cost of verifying one candidate against scanning one posting.
VERIFY_COST = 20.0

_BLOCK = "bucket int, ids binary, counts binary, toks binary, own_ids binary, sizes binary"
_BLOCK2 = "bucket int, token_bucket int, ids binary, counts binary, toks binary, dfs binary, firsts binary, own_ids binary, sizes binary"
_DOC = "doc_id long, n int, m int, sig string, mh long, prefix array<long>, firsts array<long>, costs array<int>, toks binary"
_PAIR = "a long, b long, shared long, need int, na int, nb int, h long"


def _need(n: np.ndarray | int, t: float):
    """Smallest overlap that a set of n tokens must have with any partner."""
    return np.ceil(np.asarray(n) * t - 1e-9).astype(np.int64)


def _by_bucket(bucket: np.ndarray, n: int):
    order = np.argsort(bucket.astype(np.uint16 if n <= 65535 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    return order, ends


def _scatter(n: int, buckets: int):
    """N-grams by bucket of their hash: documents, how many of each, and the low 40 bits; a document's number of n-grams
    goes once, to a bucket of its own."""
    def run(batches):
        for b in (x.slice(i, ROWS_AT_ONCE) for x in batches for i in range(0, x.num_rows, ROWS_AT_ONCE)):
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(zero_copy_only=False), kind="stable")))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            toks, counts = C.ngram_sets(b.column(1), n)
            if not len(toks):
                continue
            row = np.repeat(np.arange(len(ids)), counts)
            order, ends = _by_bucket(((toks >> U(40)) % U(buckets)).astype(np.int64), buckets)
            row, toks = row[order], toks[order]
            some = np.flatnonzero(counts)
            home = (C.mix(ids[some].astype(np.int64).view(U)) % U(buckets)).astype(np.int64)
            by, homes = _by_bucket(home, buckets)
            some = some[by]
            out, a, h = [], 0, 0
            for k, e in enumerate(ends):
                r, own = row[a:e], some[h : homes[k]]
                if len(r) or len(own):
                    at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else r
                    out.append((k, C.planes(ids[r[at]].astype(np.int64)), C.planes(np.diff(np.append(at, len(r))).astype(np.uint32)), C.pack(toks[a:e], 5), C.planes(ids[own].astype(np.int64)), C.planes(counts[own].astype(np.uint32))))
                a, h = e, homes[k]
            yield _batch(out, _BLOCK)
            C.trim()

    return run


def _batch(rows, schema: str):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    cols = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(list(c), kinds[k]) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _joined(col, dtype):
    return np.concatenate([C.unplanes(x.as_buffer(), dtype) for x in col]) if len(col) else np.zeros(0, dtype)


def _unpacked(col, width: int = 5):
    return C.unpack(b"".join(x.as_buffer() for x in col), width)


def _count(doc_buckets: int):
    """Of one token bucket: document frequencies; the tokens of at least two documents go back to their documents.

    A frequency goes as the eighth of an octave that it lies in. With each token goes the hash of one of its documents,
    the same for all: tokens of one group of copies mostly agree in it, which puts a pair's tokens into few buckets.
    """

    def run(t: pa.Table):
        bucket = t.column("bucket")[0].as_py()
        ids, counts = _joined(t.column("ids"), np.int64), _joined(t.column("counts"), np.uint32).astype(np.int64)
        toks = _unpacked(t.column("toks"))
        own_ids, sizes = _joined(t.column("own_ids"), np.int64), _joined(t.column("sizes"), np.uint32)
        del t
        by = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int32)
        rank[by] = np.arange(len(ids), dtype=np.int32)
        doc = np.repeat(rank, counts)
        ids = ids[by]
        order = np.argsort(toks)
        s = toks[order]
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else order
        del s
        run_len = np.diff(np.append(at, len(toks)))
        hashed = C.mix(ids.view(U))
        first = np.minimum.reduceat(hashed[doc[order]], at) if len(at) else hashed[:0]
        df, who = np.empty(len(toks), np.uint8), np.empty(len(toks), np.uint32)
        df[order] = np.repeat(np.where(run_len > 1, np.minimum(np.rint(8 * np.log2(run_len)), 255), 0).astype(np.uint8), run_len)
        who[order] = np.repeat((first >> U(40)).astype(np.uint32), run_len)
        del order
        keep = df > 0
        doc, toks, df, who = doc[keep], toks[keep], df[keep], who[keep]
        own = (hashed % U(doc_buckets)).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        by, ends = _by_bucket(own[doc[order]], doc_buckets)
        order = order[by]
        doc, toks, df, who = doc[order], toks[order], df[order], who[order]
        by = np.argsort(own_ids, kind="stable")
        own_ids, sizes = own_ids[by], sizes[by]
        by, homes = _by_bucket((C.mix(own_ids.view(U)) % U(doc_buckets)).astype(np.int64), doc_buckets)
        own_ids, sizes = own_ids[by], sizes[by]
        out, a, h = [], 0, 0
        for k, e in enumerate(ends):
            d, i = doc[a:e], slice(h, homes[k])
            if len(d) or len(own_ids[i]):
                at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else d
                out.append((k, bucket, C.planes(ids[d[at]]), C.planes(np.diff(np.append(at, len(d))).astype(np.uint32)), C.pack(toks[a:e], 5), df[a:e].tobytes(), C.pack(who[a:e].astype(U), 3), C.planes(own_ids[i]), C.planes(sizes[i])))
            a, h = e, homes[k]
        yield _batch(out, _BLOCK2)

    return run


def choose_m(df: np.ndarray, k1: int) -> int:
    """The multiplicity of least estimated cost, for recurring tokens of ascending frequency ``df``.

    With k = k1 + m - 1 indexed tokens, S = sum of (df - 1) postings are scanned; at most S / m documents can share
    m of them, and each is verified at VERIFY_COST.
    """
    s = np.cumsum(df - 1.0)[k1 - 1 :]
    m = np.arange(1, len(s) + 1)
    return int(np.argmin(s + VERIFY_COST * s / m)) + 1


def _assemble(t: float):
    """Of one bucket of documents: drop those that cannot have a partner, choose m, cut the prefix."""

    def run(tb: pa.Table):
        import hashlib

        ids = _joined(tb.column("ids"), np.int64)
        own_ids, sizes = _joined(tb.column("own_ids"), np.int64), _joined(tb.column("sizes"), np.uint32).astype(np.int64)
        counts = _joined(tb.column("counts"), np.uint32).astype(np.int64)
        toks, dfs, firsts = _unpacked(tb.column("toks")), np.frombuffer(b"".join(x.as_buffer() for x in tb.column("dfs")), np.uint8), _unpacked(tb.column("firsts"), 3)
        toks |= np.repeat(tb.column("token_bucket").to_numpy().astype(U) << U(40), [len(x.as_buffer()) // 5 for x in tb.column("toks")])
        uniq, inv = np.unique(ids, return_inverse=True)
        if not len(uniq):
            return
        by = np.argsort(own_ids)
        n = sizes[by][np.searchsorted(own_ids, uniq, sorter=by)]
        r = np.bincount(inv, counts, len(uniq)).astype(np.int64)
        fits = r >= _need(n, t)
        doc = np.repeat(inv, counts)
        keep = fits[doc]
        doc, toks, dfs, firsts = doc[keep], toks[keep], dfs[keep], firsts[keep]
        order = np.lexsort((toks, dfs, doc))
        doc, toks, dfs, firsts = doc[order], toks[order], np.exp2(dfs[order] / 8.0), firsts[order].astype(np.int64)
        ends = np.cumsum(np.bincount(doc, minlength=len(uniq)))
        out = []
        for i in np.flatnonzero(fits):
            a, e, size = ends[i] - r[i], ends[i], int(n[i])
            own, f = toks[a:e], dfs[a:e]
            k1 = size - int(_need(size, t)) + 1 - (size - int(r[i]))
            m = choose_m(f, k1)
            raw = own.tobytes()
            sig = hashlib.blake2b(np.sort(own).tobytes(), digest_size=16).hexdigest() if r[i] == size else None
            out.append((int(uniq[i]), size, m, sig, int(C.mix(own).min().astype(np.int64)), own[: k1 + m - 1].view(np.int64), firsts[a : a + k1 + m - 1], np.minimum(f[: k1 + m - 1], 1e9).astype(np.int32), raw))
            if len(out) == ROWS_AT_ONCE:
                yield _batch(out, _DOC)
                out = []
        yield _batch(out, _DOC)

    return run


def _postings(tb: pa.Table):
    """Facts of the documents of a bucket (id, n, m, mh, label, side), and the postings (document, token) by number."""
    ids, first, doc = np.unique(tb.column("doc_id").to_numpy(), return_index=True, return_inverse=True)
    facts = [tb.column(c).to_numpy()[first] for c in ("n", "m", "mh", "label", "side")]
    return ids, facts, doc, np.unique(tb.column("tok").to_numpy(), return_inverse=True)[1]


def _facts(ids, n, m, mh, a, b, shared) -> pa.Table:
    h = C.mix(C.mix(mh[a].view(U)) + C.mix(mh[b].view(U))).view(np.int64)
    return pa.table({"a": ids[a], "b": ids[b], "shared": shared.astype(np.int64), "need": np.minimum(m[a], m[b]).astype(np.int32), "na": n[a].astype(np.int32), "nb": n[b].astype(np.int32), "h": h})


def _links(t: float):
    """Of one bucket of postings: for each document the partner, of the smallest ones of its tokens, that shares most."""

    def run(tb: pa.Table) -> pa.Table:
        C.trim()
        ids, (n, m, mh, _, _), doc, tok = _postings(tb)
        hub = np.full(int(tok.max()) + 1, len(ids))
        np.minimum.at(hub, tok, doc)
        key, c = np.unique(doc * len(ids) + hub[tok], return_counts=True)
        b, a = key // len(ids), key % len(ids)
        fits = (a != b) & (np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b]) - 1e-9) & (c >= np.minimum(m[a], m[b]))
        a, b, c = a[fits], b[fits], c[fits]
        order = np.lexsort((a, -c, b))
        order = order[np.concatenate(([True], b[order][1:] != b[order][:-1]))] if len(order) else order
        return _facts(ids, n, m, mh, a[order], b[order], c[order])

    return run


def _pairs(t: float):
    """Of one bucket of postings, or two parts of one: how many prefix tokens each pair of documents shares in it.

    Pairs of one label are left out, and with two sides those of one side.
    """

    def run(tb: pa.Table) -> pa.Table:
        C.trim()
        ids, (n, m, mh, label, side), doc, tok = _postings(tb)
        label = np.unique(label, return_inverse=True)[1]
        two = bool(side.any())
        group = side if two else label
        order = np.lexsort((doc, group[doc], tok))
        doc, tok = doc[order], tok[order]
        at = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        lab = label[doc]
        mixed = np.repeat(np.minimum.reduceat(lab, at) < np.maximum.reduceat(lab, at), np.diff(np.append(at, len(tok))))
        doc, tok = doc[mixed], tok[mixed]
        if not len(doc):
            return _facts(ids, n, m, mh, doc, doc, doc)
        # a posting meets those of the later groups of its token
        g = group[doc]
        ends = np.flatnonzero(np.concatenate(((tok[1:] != tok[:-1]) | (g[1:] != g[:-1]), [True]))) + 1
        start = np.repeat(ends, np.diff(np.concatenate(([0], ends))))
        last = np.flatnonzero(np.concatenate((tok[1:] != tok[:-1], [True]))) + 1
        slots = np.repeat(last, np.diff(np.concatenate(([0], last)))) - start
        at = np.argsort(doc, kind="stable")
        at = at[slots[at] > 0]
        out = []
        slots, start, own_doc = slots[at], start[at], doc[at]
        total = np.cumsum(slots)
        i = 0
        while i < len(at):
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + SLOTS_AT_ONCE, "right")))
            j = int(np.searchsorted(own_doc, own_doc[j - 1], "right")) if j < len(at) else j  # whole documents
            counts = []
            step = 4096 if total[j - 1] - base > 4 * SLOTS_AT_ONCE else j - i
            for s in range(i, j, step):
                e = min(j, s + step)
                own = slots[s:e]
                partner = doc[np.arange(int(own.sum())) + np.repeat(start[s:e] - (np.cumsum(own) - own), own)]
                counts.append(np.unique(np.repeat(own_doc[s:e], own) * len(ids) + partner, return_counts=True))
            key, c = (np.concatenate(x) for x in zip(*counts))
            if len(counts) > 1:
                key, inv = np.unique(key, return_inverse=True)
                c = np.bincount(inv, c).astype(np.int64)
            a, b = key // len(ids), key % len(ids)
            fits = (np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b]) - 1e-9) & (label[a] != label[b])
            a, b = a[fits], b[fits]
            out.append((np.minimum(a, b), np.maximum(a, b), c[fits]))
            i = j
        a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return _facts(ids, n, m, mh, a, b, c)

    return run


def _verify(t: float, spanning: bool):
    """Exact overlaps of one bucket's candidate pairs; with ``spanning`` only edges that connect something new, and pairs
    that are connected already aren't compared."""

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        C.trim()
        if not pairs.num_rows or not docs.num_rows:
            return pa.Table.from_batches([_batch([], "a long, b long, jaccard double")])
        ids = docs.column("doc_id").to_numpy()
        toks = [np.frombuffer(x.as_buffer(), U) for x in docs.column("toks")]
        lens = np.array([len(x) for x in toks])
        dense = np.unique(np.concatenate(toks), return_inverse=True)[1].astype(np.int32)
        del toks
        off = np.concatenate(([0], np.cumsum(lens)))
        by = np.argsort(ids)
        a = by[np.searchsorted(ids, pairs.column("a").to_numpy(), sorter=by)]
        b = by[np.searchsorted(ids, pairs.column("b").to_numpy(), sorter=by)]
        size = pairs.column("na").to_numpy().astype(np.int64) + pairs.column("nb").to_numpy()
        order = np.lexsort((b, a))
        mark, label = np.zeros(int(dense.max()) + 1, bool), np.arange(len(ids))
        cuts = np.flatnonzero(np.concatenate(([True], a[order][1:] != a[order][:-1], [True])))
        hits = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            x, todo = a[order[s]], order[s:e]
            if spanning:
                todo = todo[label[b[todo]] != label[x]]
            mark[dense[off[x] : off[x + 1]]] = True
            while len(todo):
                k = max(1, int(np.searchsorted(np.cumsum(lens[b[todo]]), TOKENS_AT_ONCE, "right")))
                now, todo = todo[:k], todo[k:]
                own = lens[b[now]]
                first = np.cumsum(own) - own
                over = np.add.reduceat(mark[dense[np.arange(int(own.sum())) + np.repeat(off[b[now]] - first, own)]].astype(np.int64), first)
                j = over / (size[now] - over)
                hit = j >= t - 1e-12
                now, j = now[hit], j[hit]
                if spanning and len(now):
                    _, new = np.unique(label[b[now]], return_index=True)
                    now, j = now[new], j[new]
                    now, j = now[label[b[now]] != label[x]], j[label[b[now]] != label[x]]
                    label[np.isin(label, label[b[now]])] = label[x]
                hits.append((now, j))
            mark[dense[off[x] : off[x + 1]]] = False
        hit, j = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": ids[a[hit]], "b": ids[b[hit]], "jaccard": j})

    return run


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``a`` shares with each of ``b``: frequent ones by matrix products, the rest one by one."""
    na, nb = len(a), len(b)
    over = np.zeros((na, nb), np.int32)
    flat = over.ravel()
    inv = np.unique(np.concatenate(a + b), return_inverse=True)[1]
    cut = sum(map(len, a))
    tok_a, tok_b = inv[:cut], inv[cut:]
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    df_a, df_b = (np.bincount(x, minlength=int(inv.max(initial=0)) + 1) for x in (tok_a, tok_b))
    work = df_a * df_b
    heavy = work * DENSE > na * nb
    col = np.cumsum(heavy) - 1
    sides = []
    for tok, row in ((tok_a, row_a), (tok_b, row_b)):
        at = np.flatnonzero(heavy[tok])
        at = at[np.argsort(col[tok[at]], kind="stable")]
        sides.append((col[tok[at]], row[at]))
    for first in range(0, int(heavy.sum()), NGRAMS_A_PRODUCT):
        width = min(NGRAMS_A_PRODUCT, int(heavy.sum()) - first)
        m = []
        for (c, row), rows in zip(sides, (na, nb)):
            i, j = np.searchsorted(c, (first, first + width))
            m.append(np.zeros((rows, width), np.float32))
            m[-1][row[i:j], c[i:j] - first] = 1
        over += (m[0] @ m[1].T).astype(np.int32)
    at = np.flatnonzero((work > 0)[tok_a] & ~heavy[tok_a])
    slots, base = df_b[tok_a[at]], row_a[at] * nb
    start = (np.cumsum(df_b) - df_b)[tok_a[at]]
    row_b = row_b[np.argsort(tok_b, kind="stable")]
    total = np.cumsum(slots)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLOTS_AT_ONCE, "right")))
        own = slots[i:j]
        np.add.at(flat, np.repeat(base[i:j], own) + row_b[np.arange(int(own.sum())) + np.repeat(start[i:j] - (np.cumsum(own) - own), own)], 1)
        i = j
    return over


def _degrees(t: float):
    """Of some groups, or of two parts of one: for each document the weight of those that are its partners."""

    def run(tb: pa.Table) -> pa.Table:
        C.trim()
        ids, root, n, w, side = (tb.column(c).to_numpy() for c in ("doc_id", "root", "n", "w", "side"))
        toks = [np.frombuffer(x.as_buffer(), U) for x in tb.column("toks")]
        two = tb.column("lo")[0].as_py() != tb.column("hi")[0].as_py()
        links = np.zeros(len(ids), np.int64)
        order = np.argsort(root, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], root[order][1:] != root[order][:-1], [True])))
        for s, e in zip(cuts[:-1], cuts[1:]):
            a = b = order[s:e]
            if two:
                a, b = a[side[a] == 0], b[side[b] > 0]
            if not len(a) or not len(b):
                continue
            over = _overlaps([toks[i] for i in a], [toks[i] for i in b])
            for i in range(0, len(a), ROWS_A_BLOCK):
                own, o = a[i : i + ROWS_A_BLOCK], over[i : i + ROWS_A_BLOCK]
                hit = o / (n[own][:, None].astype(np.int64) + n[b] - o) >= t - 1e-12
                if two:
                    links[b] += w[own] @ hit
                else:
                    hit[np.arange(len(own)), np.arange(i, i + len(own))] = False
                links[own] += hit @ w[b]
        return pa.table({"doc_id": ids, "links": links})

    return run


def _one_row_an_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    again = d.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return d
    again = C.maybe_broadcast(again)
    return d.join(again, "doc_id", "left_anti").unionByName(d.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def _join(docs: DataFrame, n: int, t: float, id_col: str, text_col: str, spanning: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """(copies: doc_id, rep of equal sets; pairs of reps: a < b, jaccard; all documents; reps with their prefixes; buckets of postings)."""
    if not 0 < t <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    size = C.measured(docs.select(F.col(text_col).cast("string").alias("text")))[1]
    buckets = C.parts(size, TOKENS_A_BUCKET * 6)  # bytes of text an n-gram, about
    doc_buckets = C.parts(size, DOCS_A_BUCKET * 2000)
    d = _one_row_an_id(docs, id_col, text_col)
    blocks = d.mapInArrow(_scatter(n, buckets), _BLOCK)
    back = C.by_bucket(blocks, buckets, "bucket", _count(doc_buckets), _BLOCK2)
    table = C.materialize(C.by_bucket(back, doc_buckets, "bucket", _assemble(t), _DOC))

    reps = table.where("sig is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"))
    copies = table.where("sig is not null").select("doc_id", "sig", "n").join(reps, ["sig", "n"]).select("doc_id", "rep")
    copies = C.materialize(copies)
    extra = C.maybe_broadcast(copies.where("doc_id != rep").select("doc_id"))
    own = table.select("doc_id", "n", "m", "mh", "prefix", "firsts", "costs").join(extra, "doc_id", "left_anti")
    k = C.parts(own.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0], POSTINGS_A_BUCKET)
    reps = own
    if not spanning:
        return copies, _compared(_candidates(own.withColumn("label", F.col("doc_id")), k, t), table, t, False), table, reps, k
    post = _exploded(own.withColumn("label", F.col("doc_id")), k).withColumn("side", F.lit(0))
    links = post.repartition(min(k, C.MAX_PARTS), "bucket").groupBy("bucket").applyInArrow(_links(t), _PAIR)
    links = links.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb", "h"), F.struct("shared", -F.col("a"))).alias("x")).select("x.a", "b", "x.na", "x.nb", "x.h")
    links = C.materialize(_compared(links, table, t, True))
    known = C.maybe_broadcast(C.materialize(components(links.select("a", "b"))))
    own = own.join(known, "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id"))
    return copies, links.unionByName(_compared(_candidates(own, k, t), table, t, True)), table, reps, k


def _exploded(own: DataFrame, k: int) -> DataFrame:
    x = own.select("doc_id", "n", "m", "mh", "label", F.explode(F.arrays_zip("prefix", "firsts", "costs")).alias("x"))
    return x.select(F.pmod("x.firsts", F.lit(k)).cast("int").alias("bucket"), F.col("x.prefix").alias("tok"), "doc_id", "n", "m", "mh", "label", F.col("x.costs").alias("cost"))


def _candidates(own: DataFrame, k: int, t: float) -> DataFrame:
    """Pairs that share enough prefix tokens: (a, b, na, nb, h)."""
    post = _exploded(own, k)
    # each posting meets half of those of its token
    work = post.groupBy("bucket").agg((F.sum(F.col("cost") - 1.0) / 2).alias("work")).where(F.col("work") > SLOTS_A_TASK)
    hot = C.materialize(work.select("bucket", F.ceil(F.sqrt(F.col("work") / SLOTS_A_TASK)).cast("int").alias("r")))
    post = post.drop("cost").join(C.maybe_broadcast(hot), "bucket", "left").withColumn("r", F.coalesce("r", F.lit(1)))
    post = post.withColumn("g", F.pmod(F.xxhash64("doc_id"), "r").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    post = post.withColumns({"lo": F.least("g", "o"), "hi": F.greatest("g", "o")}).withColumn("side", ((F.col("lo") != F.col("hi")) & (F.col("g") == F.col("hi"))).cast("int")).drop("r", "g", "o")
    n = min(C.MAX_PARTS, k + (hot.agg(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0))).first()[0]))
    near = post.repartition(n, "bucket", "lo", "hi").groupBy("bucket", "lo", "hi").applyInArrow(_pairs(t), _PAIR)
    cand = near.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *(F.first(c).alias(c) for c in ("need", "na", "nb", "h"))).where("shared >= need")
    return cand.select("a", "b", "na", "nb", "h")


def _compared(cand: DataFrame, table: DataFrame, t: float, spanning: bool) -> DataFrame:
    """The candidates that are pairs: (a, b, jaccard)."""
    cand = C.materialize(cand)
    docs = cand.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("na").alias("n"), "h"), F.struct(F.col("b").alias("doc_id"), F.col("nb").alias("n"), "h"))).alias("x")).select("x.*")
    tokens = docs.select("doc_id", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    k = max(C.parts(cand.count(), PAIRS_A_BUCKET), C.parts(tokens, TOKENS_A_TASK))
    bucket = F.pmod("h", F.lit(k)).cast("int").alias("k")
    cand = cand.select("*", bucket)
    work = docs.select(bucket, "doc_id", "n").distinct().groupBy("k").agg(F.sum("n").alias("t")).join(cand.groupBy("k").count(), "k")
    r = F.greatest(F.ceil(F.sqrt(F.col("count") / PAIRS_A_TASK)), F.ceil(F.col("t") / (3 * TOKENS_A_TASK))).cast("int")
    hot = C.materialize(work.select("k", r.alias("r")).where("r > 1"))
    r = F.coalesce("r", F.lit(1))
    cand = cand.join(C.maybe_broadcast(hot), "k", "left").withColumns({"i": F.pmod(F.xxhash64("a"), r).cast("int"), "j": F.pmod(F.xxhash64("b"), r).cast("int")}).drop("r")
    keys = ["k", "i", "j"]
    ship = cand.select(*(F.col(c).alias(f"at_{c}") for c in keys), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ship = table.select("doc_id", "toks").join(C.maybe_broadcast(ship), "doc_id")
    at = [f"at_{c}" for c in keys]
    return cand.select(*keys, "a", "b", "na", "nb").groupBy(*keys).cogroup(ship.select(*at, "doc_id", "toks").groupBy(*at)).applyInArrow(_verify(t, spanning), "a long, b long, jaccard double")


def jaccard_pairs(docs: DataFrame, *, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of documents whose word n-gram sets have Jaccard similarity of at least ``threshold``.

    Returns (doc_a, doc_b, jaccard) with doc_a < doc_b, one row a pair, equal sets included with 1.0; similarities
    are rounded to 6 places. Rows whose id or text is null, and texts without a word, have no pairs; a text of
    fewer than n words has one n-gram, made of all of them. Rows that repeat an id are one document, with the
    smallest of their texts. Texts are used whole. Ids are integers, or cast to them. Other columns are ignored whatever their names; an empty table
    gives an empty result.
    """
    copies, pairs, *_ = _join(docs, n, threshold, id_col, text_col, False)
    pairs = C.materialize(pairs)
    many = copies.groupBy("rep").agg(F.collect_list("doc_id").alias("ids")).where("size(ids) > 1")
    same = many.select(F.explode("ids").alias("doc_a"), "ids").select("doc_a", F.explode("ids").alias("doc_b")).where("doc_a < doc_b").select("doc_a", "doc_b", F.lit(1.0).alias("jaccard"))
    small = C.maybe_broadcast(many, BROADCAST_GROUPS)
    for side in ("a", "b"):
        pairs = pairs.join(small.select(F.col("rep").alias(side), F.col("ids").alias(f"ids_{side}")), side, "left")
    wide = pairs.select(F.explode(F.coalesce("ids_a", F.array("a"))).alias("x"), "b", "ids_b", "jaccard").select("x", F.explode(F.coalesce("ids_b", F.array("b"))).alias("y"), "jaccard")
    return wide.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard")).unionByName(same)


#: Groups of equal sets that are broadcast when pairs are expanded; beyond it the join shuffles.
BROADCAST_GROUPS = 20_000
#: A group of several blocks is sparse where its postings meet fewer others than its documents squared, as one in so many.
SPARSE = 4
#: Edges that one task joins in memory; beyond it components are found by distributed star contraction.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(doc_id, root) of every vertex of edges (a, b); root is the smallest id of its connected component."""
    e = C.materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")))
    if e.count() <= local_edges:

        def union(batches):
            t = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            x, y = (np.concatenate(c) for c in zip(*t)) if t else (np.zeros(0, np.int64),) * 2
            ids, at = np.unique(np.concatenate((x, y)), return_inverse=True)
            x, y, label = at[: len(x)], at[len(x) :], np.arange(len(ids))
            while len(x):
                lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
                if (lo == hi).all():
                    break
                np.minimum.at(label, hi, lo)  # roots are hooked to smaller ones, then all paths are cut short
                while (label[label] != label).any():
                    label = label[label]
            yield pa.record_batch({"doc_id": pa.array(ids), "root": pa.array(ids[label])})

        return e.coalesce(1).mapInArrow(union, "doc_id long, root long")
    e = e.where("a != b")
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        new = C.materialize(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("a").alias("doc_id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("doc_id"), F.col("b").alias("root")).distinct())


def _linked(group: DataFrame, table: DataFrame, own: DataFrame, k: int, t: float) -> DataFrame:
    """Of reps in groups (doc_id, root, n, w, slots): (doc_id, links), the weight w of each one's partners.

    In a group of two each is the other's partner. Others are compared all with all in blocks; a group of more than a block in
    which few pairs share a prefix token goes by candidates instead.
    """
    size = group.groupBy("root").agg(F.count("*").alias("g"), F.sum("w").alias("all"), F.sum("n").alias("t"), F.sum("slots").alias("s"))
    r = F.greatest(F.ceil(F.col("g") / DOCS_A_BLOCK), F.when(F.col("t") > TOKENS_A_TASK, F.ceil(2 * F.col("t") / TOKENS_A_TASK)).otherwise(1)).cast("int")
    sparse = (F.col("r") > 1) & (F.col("s") < F.col("g") * F.col("g") / SPARSE)
    size = C.materialize(size.withColumn("r", r).withColumn("way", F.when(F.col("g") == 2, "two").when(sparse, "sparse").otherwise("blocks")))
    group = C.materialize(group.join(C.maybe_broadcast(size.select("root", "all", "r", "way")), "root"))
    two = group.where("way = 'two'").select("doc_id", (F.col("all") - F.col("w")).alias("links"))
    whole, parts = size.where("way = 'blocks'").agg(F.coalesce(F.sum(F.when(F.col("r") == 1, F.col("t"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("r") > 1, F.col("r") * (F.col("r") + 1) / 2)), F.lit(0)).cast("long")).first()
    buckets = C.parts(whole, TOKENS_A_TASK // 3)
    x = table.select("doc_id", "toks").join(C.maybe_broadcast(group.where("way = 'blocks'").select("doc_id", "root", "n", "w", "r")), "doc_id")
    # whole groups share a bucket; the parts of a divided one, from 1, meet each other in pairs
    hot = F.col("r") > 1
    x = x.withColumn("g", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.col("r")) + 1).otherwise(0).cast("int"))
    x = x.withColumn("o", F.explode(F.when(hot, F.sequence(F.lit(1), F.col("r"))).otherwise(F.array(F.lit(0)))))
    x = x.withColumns({"key": F.when(hot, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(buckets))), "lo": F.least("g", "o"), "hi": F.greatest("g", "o")})
    x = x.withColumn("side", ((F.col("lo") != F.col("hi")) & (F.col("g") == F.col("hi"))).cast("int")).drop("r", "g", "o")
    blocks = x.repartition(min(C.MAX_PARTS, buckets + parts), "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(_degrees(t), "doc_id long, links long")
    few = group.where("way = 'sparse'")
    if not few.isEmpty():
        pairs = _compared(_candidates(own.join(C.maybe_broadcast(few.select("doc_id")), "doc_id", "left_semi").withColumn("label", F.col("doc_id")), k, t), table, t, False)
        ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        blocks = blocks.unionByName(ends.join(C.maybe_broadcast(few.select(F.col("doc_id").alias("b"), "w")), "b").select(F.col("a").alias("doc_id"), F.col("w").alias("links")))
    return two.unionByName(blocks.groupBy("doc_id").agg(F.sum("links").alias("links")))


def jaccard_classes(docs: DataFrame, *, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links) of every document: links is the number of pairs of ``jaccard_pairs`` that it is in, copies
    included, and class_id the smallest id of those that links connect with it, directly or not; without a link, its own.

    One row an id. Rows of null id have none; documents whose text is null or has no word have no links. Other edge cases are
    those of ``jaccard_pairs``.
    """
    copies, pairs, table, own, k = _join(docs, n, threshold, id_col, text_col, True)
    root = C.materialize(components(pairs.select("a", "b")))
    many = C.materialize(copies.groupBy(F.col("rep").alias("doc_id")).agg(F.count("*").alias("w")).where("w > 1"))
    facts = own.select("doc_id", "n", F.expr("aggregate(costs, 0L, (s, x) -> s + x - 1)").alias("slots"))
    group = facts.join(C.maybe_broadcast(root), "doc_id").join(C.maybe_broadcast(many), "doc_id", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    linked = C.materialize(_linked(group, table, own, k, threshold))
    reps = root.join(linked, "doc_id").join(many, "doc_id", "full")
    reps = C.materialize(reps.select(F.col("doc_id").alias("rep"), F.coalesce("root", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).alias("links")))
    more = copies.where("doc_id != rep").join(C.maybe_broadcast(reps), "rep").select("doc_id", "class_id", "links")
    found = C.maybe_broadcast(C.materialize(reps.withColumnRenamed("rep", "doc_id").unionByName(more)))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicates(docs: DataFrame, *, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root) of every document with a partner; root is the smallest id of its group.

    Groups are the connected components of ``jaccard_pairs``. Pairs within what is already connected aren't compared,
    so that a group of g documents costs about g comparisons here. Edge cases are those of ``jaccard_pairs``.
    """
    copies, pairs, *_ = _join(docs, n, threshold, id_col, text_col, True)
    return components(pairs.select("a", "b").unionByName(copies.where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))


def drop_near_duplicates(docs: DataFrame, *, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the members of each group but its smallest id; columns and other rows are unchanged.

    Rows without id, text or words stay; of rows that repeat an id that stays, all stay.
    """
    gone = near_duplicates(docs, n=n, threshold=threshold, id_col=id_col, text_col=text_col).where("doc_id != root").select(F.col("doc_id").alias("__gone"))
    gone = C.maybe_broadcast(C.materialize(gone))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


#: jaccard_pairs with its default parameters over documents.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(min(text)), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b, round(k / (x.n + y.n - k)::double, 6) AS jaccard FROM p JOIN n x ON doc_a = x.doc_id JOIN n y ON doc_b = y.doc_id WHERE k / (x.n + y.n - k)::double >= 0.5
"""

#: jaccard_classes with its default parameters over documents: the pairs of ORACLE_SQL, counted and connected.
CLASSES_SQL = rf"""
WITH RECURSIVE pairs AS MATERIALIZED ({ORACLE_SQL}),
e AS MATERIALIZED (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
d AS MATERIALIZED (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a AND r.root < e.b),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (doc_id)
"""
