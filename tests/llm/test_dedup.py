"""Near, embedding and substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexweave.llm import components, embedding, minhash, substring


def words(text):
    return (text or "").encode().split()


def reach(ids, links):
    near = {i: {i} for i in ids}
    root = {i: i for i in ids}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(ids):
        todo = [i]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if root[y] > root[i]:
                    root[y] = root[i]
                    todo.append(y)
    return root


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = reach(ids, links)
    return {i: (i, len(sets[i]), root[i], root[i] == i) for i in ids}


def copies(seed, groups, each, length, edits):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    out = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=length)
        for _ in range(each):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    texts = copies(1, 12, 9, 120, 7) + copies(2, 1, 60, 100, 9) + [None, "", "   ", "one", "One", "two words", "x " * 30_000, "x " * 29_000, "A B C D", "a b c d", "É b c d"]
    got = {r[0]: tuple(r) for r in minhash.near_duplicates(docs(texts), words=k).collect()}
    assert got == brute_near(list(enumerate(texts)), k)


def test_blocks_join_what_pivots_miss(spark, docs, monkeypatch):
    """A bucket's least member links with few; the others are joined block by block."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = copies(5, 2, 80, 150, 16)
    got = {r[0]: tuple(r) for r in minhash.near_duplicates(docs(texts), words=4).collect()}
    want = brute_near(list(enumerate(texts)), 4)
    assert got == want and len({v[2] for v in want.values()}) > 2


def pairs_behind_pivots(seed, n, share, size=90):
    """Of n pairs of texts of similarity ``share``/``size``, one word a shingle, those that share a band, but only after one where
    just the minima's low bytes agree; and for each band they share a text of its least words, which is like neither."""
    r = np.random.default_rng(seed)
    alone = (size - share) // 2
    sets = []
    for _ in range(n):
        w = [f"{x:x}" for x in r.integers(1 << 60, size=size)]
        sets += [w[: share + alone], w[:share] + w[share + alone :]]

    def minima_of(lists):
        raw = [" ".join(x).encode() for x in lists]
        values, begin = minhash.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
        return minhash.minima(values, begin[:-1], minhash.BANDS * minhash.ROWS).T.reshape(len(lists), minhash.BANDS, minhash.ROWS)

    m = minima_of(sets)
    low = minhash.mix64(m).astype(np.uint8)
    equal, bytes_equal = (m[::2] == m[1::2]).all(axis=2), (low[::2] == low[1::2]).all(axis=2)
    pivots, pairs = [], []
    for k in np.flatnonzero(equal.any(axis=1) & (equal.argmax(axis=1) != bytes_equal.argmax(axis=1))):
        least = minima_of([[x] for x in sets[2 * k]])
        for b in np.flatnonzero(equal[k]):
            pivots.append(" ".join(sorted({sets[2 * k][(least[:, b, i] == m[2 * k, b, i]).argmax()] for i in range(minhash.ROWS)})))
        pairs += [" ".join(x) for x in sets[2 * k : 2 * k + 2]]
    return pivots, pairs


def test_first_shared_band_is_one_of_keys(spark, docs):
    """Equal low bytes of an earlier band's minima don't keep a pair from being judged."""
    pivots, pairs = pairs_behind_pivots(11, 600, 72)
    rows = list(enumerate(pivots + pairs))
    got = {r[0]: tuple(r) for r in minhash.near_duplicates(docs(pivots + pairs), words=1).collect()}
    assert pairs and got == brute_near(rows, 1)


def test_repeated_ids_are_one_document(spark, docs):
    """Rows of one id with several texts join what each of them links with."""
    texts = copies(9, 6, 5, 60, 4) + ["", None]
    r = random.Random(10)
    rows = [(r.randrange(14), t) for t in texts for _ in range(2)] + [(20, "p q r s t"), (21, "p q r s t"), (21, "other words stand here now"), (22, "other words stand here now"), (21, "")]
    rows += rows[:3]
    got = [tuple(x) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()]
    each = brute_near([(k, t) for k, (_, t) in enumerate(rows)], 4)
    ids = {i for i, _ in rows}
    root = reach(ids, [(rows[k][0], rows[v[2]][0]) for k, v in each.items()])
    want = [(i, each[k][1], root[i], root[i] == i) for k, (i, _) in enumerate(rows)]
    assert sorted(got) == sorted(want)
    named = spark.createDataFrame([(f"d{i:02}", t) for i, t in rows], "doc_id string, text string")
    assert sorted((x[0], x[2]) for x in minhash.near_duplicates(named, words=4).collect()) == sorted((f"d{i:02}", f"d{c:02}") for i, _, c, _ in want)


def test_near_duplicate_rows(spark, docs, none):
    assert minhash.near_duplicates(none).count() == 0
    twice = docs(["a b c d e f g", None]).unionByName(docs(["a b c d e f g"]))
    assert sorted(map(tuple, minhash.near_duplicates(twice).collect())) == [(0, 3, 0, True), (0, 3, 0, True), (1, 0, 1, True)]
    null = docs(["p q r s t u"]).selectExpr("cast(null as long) doc_id", "text")
    assert tuple(minhash.near_duplicates(null).first()) == (None, 2, None, True)


def test_minhash_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, minhash.op1_minhash(spark, sf).collect())) == sorted(con.sql(minhash.SQL).fetchall())


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == reach({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def brute_substring(texts, n=35):
    at = Counter(tuple(w[i : i + n]) for t in texts for w in [words(t)] for i in range(len(w) - n + 1))
    out = {}
    for k, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if at[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (k, len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring(spark, docs):
    r = random.Random(4)
    w = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("aeiou") + str(r.randrange(40)) for _ in range(n)]
    passages = [w(n) for n in (34, 35, 36, 52, 80)]
    texts = []
    for p in passages:
        for _ in range(3):
            cut = r.randrange(0, 40)
            texts.append(" ".join(w(cut) + p + w(r.randrange(0, 60))))
    texts += [None, "", " \n\t", "same " * 100, "short text", "  ".join(w(50)) + "\n", texts[0], texts[0], " ".join(w(20) * 3), " ".join(w(70)).upper()]
    df = docs(texts)
    got = {r[0]: tuple(r) for r in substring.digests(df).collect()}
    assert got == brute_substring(texts)
    kept = {r.doc_id: r for r in substring.remove(df).collect()}
    for k, (_, _, n, digest) in got.items():
        assert hashlib.sha256(b" ".join(words(kept[k].text))).hexdigest() == digest
        assert kept[k].component_id == "x"
        if not n:
            assert kept[k].text == texts[k]


def test_substring_rows(spark, docs, none):
    assert substring.digests(none).count() == 0 and substring.remove(none).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    null = docs([text, text]).selectExpr("cast(null as long) doc_id", "text")
    assert [tuple(r)[:3] for r in substring.digests(null).collect()] == [(None, 40, 40)] * 2
    with pytest.raises(ValueError):
        substring.check_cover(35, 21, (0, 1))


def test_substring_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, substring.op10_substring(spark, sf).collect())) == sorted(con.sql(substring.SQL).fetchall())


def vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((30, 64))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    for k in range(120):
        v = base[k % 5] + r.standard_normal(64) * 0.1 * r.random()
        rows.append((len(rows), [float(x) for x in v], (k % 5) % 3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [1.0] * 64, None), (n + 4, [1.0] * 64, None), (n + 5, rows[0][1], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [], 0), (n + 9, [float("inf")] + [1.0] * 63, 0), (n + 10, [1e-30] * 64, 2), (n + 11, [1e-30] * 64, 2)]
    return rows


def brute_vectors(rows, cosine=0.98):
    ok = {}
    for i, v, label in rows:
        if label is not None and v and all(np.isfinite(v)) and any(v):
            x = np.array(np.array(v, dtype=np.float64))
            x = x / np.abs(x).max()
            ok[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= cosine]
    n = Counter(x for e in links for x in e)
    root = reach([r[0] for r in rows], links)
    return {r[0]: (r[0], n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("block", [512, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n long, code string")
    assert {r[0]: tuple(r) for r in embedding.near_vectors(df).collect()} == brute_vectors(rows)
    assert {r[0]: tuple(r) for r in embedding.near_vectors(df.unionByName(df)).collect()} == brute_vectors(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding.near_vectors(df).count() == 0
    null = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding.near_vectors(null).collect()] == [(None, 0, None, True)] * 2


@pytest.mark.parametrize("d", [2, 16, 64, 300, 1024])
def test_tables_meet_at_the_bound(d):
    r = np.random.default_rng(7)
    n = 3000 if d <= 64 else 800
    a = r.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.standard_normal((n, d))
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * z
    x, y = embedding.buckets(a), embedding.buckets(b)
    meets = np.stack([(x[:, t] == y[:, t, :1]).any(1) | (y[:, t] == x[:, t, :1]).any(1) for t in range(embedding.TABLES)], 1)
    assert meets.mean() > (0.98 if d == 64 else 0.95) and meets.any(1).all()
