"""Tokens, fingerprints, languages, toxicity, pages, mixing and rollups."""

import hashlib
import math
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict
from html import unescape
from pathlib import Path

import duckdb
import numpy as np
import pages
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexweave.llm import bpe, fingerprint, html, html_pages, langid, mixing, tokens, toxicity
from lexweave.session import shared_folder


def odd_texts():
    r = random.Random(1)
    some = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F600), 10, 32])) for _ in range(r.randrange(120))) for _ in range(150)]
    return [*some, None, "", "a" * 20_000, " " * 3000, "<|endoftext|> ▁ x\x00y", "it's We'LL", "a\r\n\tb"]


def test_bpe(spark, docs, none):
    texts = odd_texts()
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs(texts), keep=("lang",)).collect()}
    for i, t in enumerate(texts):
        want = enc.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want)
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(texts)).select("doc_id", "ids")).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in back)
    assert bpe.encode(none).count() == 0


def brute_winnow(h, k, w):
    """Positions chosen from the hashes of the grams: the least of each window, the rightmost of ties."""
    n = len(h)
    out = []
    for i in range(max(1, n - w + 1) if n else 0):
        part = [(x, -j) for j, x in enumerate(h[i : i + w], i)]
        j = -min(part)[1]
        if j not in out:
            out.append(j)
    return out


def plain_tokens(text):
    """Tokens by walking the text."""
    alone = lambda c: any(low <= ord(c) <= high for low, high in [(0xE00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)])
    out, run = [], ""

    def close():
        nonlocal run
        while run:
            n = len(run) if len(run) <= fingerprint.TOKEN else next((k + 1 for k in range(fingerprint.TOKEN) if run[k] in "aeinrt0369/_.-"), fingerprint.TOKEN)
            out.append(run[:n])
            run = run[n:]

    for c in text:
        if c in " \t\n\v\f\r" or alone(c):
            close()
            out.extend([c] if alone(c) else [])
        else:
            run += c
    close()
    return out if len(out) >= fingerprint.SHORT else [c for c in text if c not in " \t\n\v\f\r"]


def plain_fingerprint(text, hashes):
    """Fingerprint as written, with a hash that truly rolls; hashes: Spark's hash of each token."""
    k, w, base, prime = fingerprint.GRAM, fingerprint.WINDOW, fingerprint.BASE, fingerprint.PRIME
    t = [hashes[x] % prime for x in plain_tokens(text)]
    if not t:
        return "", set()
    t += [0] * (k - len(t))
    h = [0]
    for x in t[:k]:
        h[0] = (h[0] * base + x) % prime
    for i in range(len(t) - k):
        h.append((base * (h[-1] - t[i] * pow(base, k - 1, prime)) + t[i + k]) % prime)
    at = brute_winnow(h, k, w)
    return ",".join(f"{h[j]:X}@{j}" for j in at), {h[j] for j in at}


def fingerprint_texts():
    r = random.Random(2)
    words = [" ".join(r.choice(["aa", "bb", "cc", "longerword"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 30, 200)]
    return [*words, None, "", "x" * 100, "same " * 50, "https://a.example/path/to_some-file.html?query=1234567890 " * 4, "長い文には空白がない。" * 9, "short one", "two", "é" * 10, "z " * 2000, "a b \x0b c", "tie", "tie", *(f"text {i} " * (i % 7) for i in range(60))]


def test_fingerprints_equal_a_plain_form(spark, docs, tmp_path):
    texts = fingerprint_texts()
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    t = [x or "" for x in texts]
    edited = [own[: len(own) - len(own) // 3] + t[i - 1][: len(own) // 3] for i, own in enumerate(t)]
    known = sorted({x for y in t + edited for x in plain_tokens(y)})
    hashes = {r.t: r.h for r in spark.createDataFrame([(x,) for x in known], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    got = {r.doc_id: r for r in fingerprint.op4_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(t)
    for i, own in enumerate(t):
        row, (f, a), (e, b) = got[i], plain_fingerprint(own, hashes), plain_fingerprint(edited[i], hashes)
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (f, e)
        assert math.isclose(row.near_edited, like(a, b)) and math.isclose(row.near_next, like(a, plain_fingerprint(t[i - 1], hashes)[1]))


def test_an_insertion_changes_the_tokens_beside_it_only():
    r = random.Random(5)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "".join(chr(0x4E00 + i) for i in range(500))):
        run = "".join(r.choices(alphabet, k=4000))
        before, after = plain_tokens(run), plain_tokens(run[:2000] + "q" + run[2000:])
        assert len(Counter(before) - Counter(after)) <= 2 * fingerprint.TOKEN


def test_shared_run_shares_a_fingerprint(spark, docs):
    run = " ".join(f"w{i}" for i in range(fingerprint.WINDOW + fingerprint.GRAM - 1))
    a, b = (r.c for r in fingerprint.choices(docs([f"q1 q2 {run} q3", f"{run} z1 z2 z3 z4"]), "text", "c").collect())
    assert {x >> 32 for x in a} & {x >> 32 for x in b}


def test_next_documents(spark, docs, none):
    assert fingerprint.with_next(none).count() == 0
    one = fingerprint.with_next(docs(["alone"])).collect()
    assert [(r.text, r.next.text) for r in one] == [("alone", "alone")]
    null = docs(["a b c d", "e"]).selectExpr("cast(null as long) doc_id", "text").unionByName(docs(["one"]).select("doc_id", "text"))
    rows = {r.text: r.next.text for r in fingerprint.with_next(null).collect()}
    assert rows["one"] in ("a b c d", "e") and set(rows.values()) == {"one", "a b c d", "e"} and rows[rows["one"]] != "one"
    # ids of any type, repeated rows, columns of clashing names
    many = spark.createDataFrame([(f"d{i:03}", f"t{i}", "x", 1, 2) for i in range(50)] + [("d007", "t7", "x", 1, 2)] * 30 + [("d007", "other", "x", 1, 2)], "name string, body string, key string, bucket int, extra int")
    got = Counter((r.id, r.text, r.next.text) for r in fingerprint.with_next(many, "name", "body").collect())
    assert sum(got.values()) == 81 and got["d049", "t49", "t48"] == 1 and got["d000", "t0", "t49"] == 1
    assert got["d007", "t7", "t7"] == 30 and sum(n for (i, _, nxt), n in got.items() if i == "d007" and nxt == "t6") == 1


@pytest.fixture(scope="module")
def some_pieces():
    pieces = langid.pieces_of(bpe.default_vocabulary()[0])
    p = np.random.default_rng(0).random((len(pieces.pieces), 2))
    return pieces, {x: i for i, x in enumerate(pieces.pieces)}, p / p.sum(axis=0)


def log_total(word, index, p):
    """Log of the sum over all segmentations into any piece of the vocabulary, in plain logarithms."""
    longest = max(map(len, index))
    a = [np.zeros(p.shape[1])]
    for end in range(1, len(word) + 1):
        parts = [a[s] + np.log(p[index[word[s:end]]]) for s in range(max(0, end - longest), end) if word[s:end] in index]
        a.append(np.logaddexp.reduce(parts, axis=0))
    return a[-1]


def test_forward_sums_all_segmentations(some_pieces, monkeypatch):
    pieces, index, p = some_pieces

    def total(w):
        return np.ones(2) if not w else sum((p[index[w[:k]]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index), np.zeros(2))

    longest = max(pieces.pieces, key=len)
    words = [b" the", b" abcabc", " état".encode(), b" x"]
    assert np.allclose(langid.forward(*langid.columns(words), p, pieces), np.log([total(w) for w in words]))
    words += [longest, b"q" + longest + b"zz", " предприятий".encode() * 3, bytes(range(128, 256)) * 8, "長い文には空白がない。".encode() * 40]
    words.sort(key=len)
    want = [log_total(w, index, p) for w in words]
    assert len(longest) > 30 and np.allclose(langid.forward(*langid.columns(words), p, pieces), want)
    monkeypatch.setattr(langid, "CELLS", 50)
    assert np.allclose(langid.forward(*langid.columns(words), p, pieces), want)


def test_expected_counts_are_those_of_all_segmentations(some_pieces):
    """Derivatives of the log sum by log probabilities, which are expected counts."""
    pieces, index, p = some_pieces
    p = p[:, :1]
    words = sorted([b" the", b" nothing", " wäre".encode(), bytes(range(130, 250)) * 4], key=len)
    weight = np.array([1.0, 2.0, 0.5, 3.0])
    got = langid.expected(*langid.columns(words), weight, p[:, 0], pieces)
    some = {index[w[s:e]] for w in words for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in index}
    assert set(np.flatnonzero(got > 0)) <= some
    for i in sorted(some)[:25]:
        up, down = p.copy(), p.copy()
        up[i] *= np.exp(1e-5)
        down[i] *= np.exp(-1e-5)
        change = sum(x * (log_total(w, index, up) - log_total(w, index, down))[0] for w, x in zip(words, weight, strict=True)) / 2e-5
        assert math.isclose(change, got[i], rel_tol=1e-4, abs_tol=1e-6)


def test_scores_are_posteriors_of_all_bytes(some_pieces):
    pieces, index, p = some_pieces
    score = langid.Model(bpe.default_vocabulary()[0], ("a", "b"), p).scorer()
    import pyarrow as pa

    texts = ["The cat, 12 dogs!", "e", "x" * 90 + " y"]
    names, best = score(pa.array(texts))
    for text, name, x in zip(texts, names, best, strict=True):
        parts = re.findall(rb"[a-z\x80-\xff]+|[0-9]+|[^a-z\x80-\xff0-9\s]+", text.lower().encode())
        total = sum(log_total(b" " + w, index, p) for w in parts)
        post = np.exp(total - np.logaddexp.reduce(total))
        assert name == "ab"[post.argmax()] and math.isclose(x, post.max(), rel_tol=1e-9)


def test_languages(spark, docs, none, sf):
    rows = {r.doc_id: r for r in langid.op2_langid(spark, sf).collect()}
    given = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [i for i in given if rows[i].held_out]
    assert np.mean([rows[i].lang_pred == given[i].lang for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    odd = ["12345 !! ² ½ ४", None, "", " ", "É", "x" * 5000, "The and THE and with"]
    got = {r.id: r for r in langid.identify(docs(odd), model).collect()}
    assert [got[i].lang_pred == "und" for i in range(len(odd))] == [True, True, True, True, False, False, False]
    assert langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs(odd), langid.train(none)).collect()} == {"und"}


def dense(rows, width):
    """(row, feature, value, rows) of a matrix."""
    x = np.array(rows, dtype=float).reshape(-1, width)
    i, j = np.nonzero(x)
    return (i, j, x[i, j], len(x)), x


def plain_risk(p, u, w, prior):
    """Positive part and part of negatives of the risk, from its definition."""
    loss = lambda x, sign: np.mean([math.log1p(math.exp(-sign * (r @ w[:-1] + w[-1]))) for r in x])
    return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)


def test_risk_is_descended_by_its_gradient():
    """Adam by the numeric gradient of the plain risk, with the step up the negative part where that is below zero, goes the same way."""
    r = np.random.default_rng(3)
    p, xp = dense(r.random((6, 3)) * (r.random((6, 3)) > 0.2), 3)
    u, xu = dense(r.random((9, 3)) * (r.random((9, 3)) > 0.9), 3)
    prior, rate, below = 0.6, 0.2, 0
    w, m, v = np.zeros(4), np.zeros(4), np.zeros(4)
    parts = lambda x: plain_risk(xp, xu, x, prior)
    for t in range(1, 41):
        under = parts(w)[1] < 0
        below += under
        aim = (lambda x: -parts(x)[1]) if under else (lambda x: sum(parts(x)))
        g = np.array([(aim(w + h) - aim(w - h)) / 2e-6 for h in np.eye(4) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        got, bias = toxicity.nnpu(p, u, 3, prior, steps=t, rate=rate, decay=0.0)
        assert np.allclose(np.append(got, bias), w, atol=1e-4)
    assert 0 < below < 40


def test_risk_prefers_the_separating_feature():
    n = 400
    bad = np.arange(n) < 60
    p = (np.repeat(np.arange(50), 1), np.zeros(50, int), np.ones(50), 50)
    u = (np.flatnonzero(bad), np.zeros(60, int), np.ones(60), n)
    w, b = toxicity.nnpu(p, u, 2, 0.15)
    assert w[0] + b > 0 > b and abs(w[1]) < 0.1


def test_shares_are_counted_over_all_texts(spark, docs, none):
    texts = ["bad word", "badly said, a bad BAD thing", None, "", "nothing"] * 30
    names = ["bad", "badl*", "thing", "noth*", "zzz"]
    found, n = toxicity.document_frequencies(docs(texts).selectExpr("doc_id as id", "text"), names)
    plain = [sum(f in toxicity.text_counts(t)[0] for t in texts) for f in names]
    assert list(found) == plain and n == len(texts)
    assert toxicity.document_frequencies(none.selectExpr("doc_id as id", "text"), names)[1] == 0


def test_toxicity(spark, docs, none, sf):
    rows = {r.doc_id: r for r in toxicity.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    y = [(rows[i].predicted, t) for i, t in labels.items() if rows[i].held_out]
    assert sum(p and not t for p, t in y) <= 1 and sum(p and t for p, t in y) >= 0.5 * sum(t for _, t in y)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    label = spark.createDataFrame([(0, 1), (1, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    texts = ["bad words here", None, "", "long " * 200_000]
    model = toxicity.train(docs(texts), label)
    assert toxicity.score(docs(texts), model).count() == 4
    texts = texts[:3]
    assert toxicity.reject(docs(texts), label.where("toxic = 0")).count() == 3
    assert toxicity.score(none, toxicity.train(none, label.limit(0))).count() == 0
    assert toxicity.reject(docs(texts), label.limit(0)).columns == docs(texts).columns


def test_pages(spark):
    decode = html.default_model().decoder()
    tp = fp = fn = 0
    for page, _, y in html.labelled(77, 120):
        got = decode(html.blocks(page))
        tp += sum(a and b for a, b in zip(got, y, strict=True))
        fp += sum(a and not b for a, b in zip(got, y, strict=True))
        fn += sum(b and not a for a, b in zip(got, y, strict=True))
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.97
    page = "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class=cookie-notice>We use cookies</div><article><h1>Big &amp; small</h1><script>var x='<p>no</p>'</script><p>First <b>bold</b>\n text&#8212;here.<!-- hidden --></p><div class='ad'>Buy now</div><p>Second para with a few more words.</article><section class=comments><p>nice post</p></section><footer>&copy; 2020</footer>"
    assert html.main_text(page, decode) == "Big & small First bold text—here. Second para with a few more words."
    rows = [(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p>" * 3000 + "x", 5), (4, "u", "<div a=\"unclosed <p>text", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text) and len(got) == 5
    assert html.extract(df.limit(0)).count() == 0


def test_all_words_of_a_name_count():
    value = "flex flex-col gap-4 mx-auto max-w-3xl px-4 comments"
    assert set(html.element("div", f' class="{value}"')[1:]) == {"flex", "col", "gap", "4", "mx", "auto", "max", "w", "3", "xl", "px", "comments"}


def path_of(node):
    out = []
    while node:
        out.append(node.element[0])
        node = node.above
    return out[::-1]


def test_pages_of_real_kinds():
    """Whole pages as sites write them, none like the training pages: the article and nothing else."""
    decode = html.default_model().decoder()
    assert [html.main_text(page, decode) for page, _ in pages.PAGES] == [text for _, text in pages.PAGES]


def test_written_pages_whole():
    """Of pages that weren't trained on, nine in ten have their text to the letter."""
    decode = html.default_model().decoder()
    writer, right = html_pages.Writer(777), 0
    for _ in range(200):
        page, written = writer.page()
        want = " ".join(" ".join(unescape(re.sub(r"<[^>]*>", "", t)).split()) for t, y in written if y)
        right += html.main_text(page, decode) == " ".join(want.split())
    assert right >= 180


@pytest.mark.parametrize("page", ["<div class='x y'>t" * 30_000, "<span>" * 30_000 + "x" + "</i>" * 30_000 + "<p>y" * 3000, "<p><div>" + "<b>" * 20_000 + "<h2></h2>" * 20_000 + "z", "<article>" + "<select>" * 20_000 + "end"])
def test_deep_and_broken_pages_cost_what_they_measure(page):
    tracemalloc.start()
    began = time.time()
    html.main_text(page, html.default_model().decoder())
    assert tracemalloc.get_traced_memory()[1] < 60e6 and time.time() - began < 40
    tracemalloc.stop()


def plain_loss(pages_, names, w):
    """Mean negative log-likelihood by going through all label paths."""
    total = 0.0
    for features, labels in pages_:
        e = [sum(w[names[f]] for f in fs) for fs in features]

        def value(y):
            return w[len(names) + 4 + y[0]] + sum(x for x, b in zip(e, y, strict=True) if b) + sum(w[len(names) + 2 * a + b] for a, b in zip(y, y[1:], strict=False))

        every = [value([(n >> i) & 1 for i in range(len(e))]) for n in range(1 << len(e))]
        total -= value(labels) - np.logaddexp.reduce(every)
    return total / len(pages_)


def test_field_is_fitted_by_its_gradient():
    """A first, small step of Adam moves each weight against the sign of the numeric gradient of the plain loss."""
    pages_ = [([["a"], ["b", "c"], ["a", "c"]], [0, 1, 1]), ([["b"], ["c"]], [1, 0]), ([["a", "b"], ["c"], ["b"], ["a"]], [0, 0, 1, 0])]
    names = {f: i for i, f in enumerate("abc")}
    vector = lambda m: np.array([m.weight[f] for f in "abc"] + [x for row in m.move for x in row] + list(m.first))
    got = vector(html.fit(pages_, steps=1, rate=1e-3))
    w = np.zeros(9)
    gradient = [(plain_loss(pages_, names, w + h) - plain_loss(pages_, names, w - h)) / 2e-5 for h in np.eye(9) * 1e-5]
    assert all(abs(g) < 1e-7 or np.sign(x) == -np.sign(g) for x, g in zip(got, gradient, strict=True))
    before, after = plain_loss(pages_, names, w), plain_loss(pages_, names, vector(html.fit(pages_, steps=300)))
    assert after < before


def test_formulas_and_drawings_are_text():
    math = "<math><semantics><mrow><msup><mi>E</mi><mn>2</mn></msup><mspace width='1em'/><mo>=</mo><mi>m</mi></mrow><annotation encoding='tex'>E^2</annotation></semantics></math>"
    drawing = "<svg><title>t</title><defs/><g><path d='M0'/><text>left</text><text>right</text></g><desc>d</desc></svg>"
    found = html.blocks(f"<article><p>Here {math} holds.</p><p>See {drawing} too.</p><script>x</script><select><option>o</select></article>")
    assert [(t, path_of(p)) for t, p, _ in found] == [("Here E2=m holds.", ["article", "p"]), ("See left right too.", ["article", "p"])]
    found = html.blocks("<article><p>One.</p><noscript>Two.</noscript><object><p>Three.</p></object><template><p>x</p></template></article>")
    assert [(t, path_of(p)) for t, p, _ in found] == [("One.", ["article", "p"]), ("Two.", ["article", "noscript"]), ("Three.", ["article", "object", "p"])]


def test_viterbi_is_the_best_path():
    page, f, _ = html.labelled(5, 3)[0]
    model = html.default_model()
    found = html.blocks(page)[:9]
    e = [sum(model.weight.get(x, 0.0) for x in html.path_features(p) + html.text_features(t, k)) for t, p, k in found]

    def value(path):
        return model.first[path[0]] + sum(x for x, y in zip(e, path, strict=True) if y) + sum(model.move[a][b] for a, b in zip(path, path[1:], strict=False))

    best = max(([(n >> i) & 1 for i in range(len(found))] for n in range(1 << len(found))), key=value)
    assert [bool(x) for x in best] == model.decoder()(found)


def brute_targets(sizes, most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[n] for n in full)
        over = sum(weight[n] for n in names if n not in full)
        target = {n: most * sizes[n] if n in full else left * weight[n] / over for n in names}
        more = {n for n in names if n not in full and target[n] > most * sizes[n] + 1e-9}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 3, None: 40}, {"x": 5}, {"a": 0, "b": 7}, {"a": 100, "é": 100, "z": 100, None: 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_mixing(spark, docs, none):
    r = random.Random(6)
    texts = [" ".join("w" for _ in range(r.choice([1, 5, 30, 200]))) + f" {i}" for i in range(700)] + [None, "", "dup dup", "dup dup"]
    df = docs(texts)
    df = df.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise("hot"))
    df = df.unionByName(df.limit(3))
    rows = mixing.mix(df, chunk=4).collect()
    taken, size, target, biggest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for x in rows:
        taken[x.source] += x.copies * x.size
        size[x.source] += x.size
        target[x.source] = x.target
        biggest[x.source] = max(biggest[x.source], x.size)
        assert 0 <= x.copies <= 3
    want = brute_targets(dict(size))
    for s in size:
        # rows that are equal are drawn as one
        assert math.isclose(target[s], want[s]) and abs(taken[s] - target[s]) <= 2 * biggest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df, chunk=4).collect()))
    out = mixing.resample(df)
    assert out.columns == df.columns
    n = Counter()
    for x in mixing.mix(df).collect():
        n[x.id] += x.copies
    assert Counter(x.doc_id for x in out.collect()) == +n
    assert mixing.mix(none).count() == 0 and mixing.resample(none).count() == 0


def test_rounding_keeps_probabilities_and_words(spark):
    """Over many sources of the same documents: how often each is taken, and what a source's words miss."""
    sizes, p, n = [1.0, 5.0, 30.0, 200.0, 7.0, 7.0, 60.0], 0.37, 600
    items = spark.createDataFrame([(f"s{i}", i * 10 + k, -i, m, p) for i in range(n) for k, m in enumerate(sizes)], "source string, k1 long, k2 long, m double, p double")
    rows = mixing.round_copies(items, chunk=3).collect()
    assert len(rows) == len({(r.k1, r.k2) for r in rows}) == n * len(sizes)
    up = Counter()
    words = Counter()
    for r in rows:
        up[r.k1 % 10] += r.up
        words[-r.k2] += sizes[r.k1 % 10] * r.up
    bound = 4 * math.sqrt(p * (1 - p) / n)
    assert all(abs(up[k] / n - p) < bound for k in range(len(sizes)))
    assert all(abs(words[i] - p * sum(sizes)) < max(sizes) for i in range(n))
    assert abs(np.mean([words[i] for i in range(n)]) - p * sum(sizes)) < 12


def test_levels_of_few_chunks_are_few_files(spark):
    """Five levels over 150 chunks, with as many shuffle partitions as a large input has."""
    items = spark.createDataFrame([("a", k, -k, float(k % 7 + 1), 0.4) for k in range(600)], "source string, k1 long, k2 long, m double, p double")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    parts = lambda: sum(1 for _ in folder.rglob("part-*"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = parts()
        rows = mixing.round_copies(items, chunk=4).collect()
        written = parts() - before
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert written <= 64 + 8  # the items, and eight for all levels
    assert sorted(r.k1 for r in rows) == list(range(600))
    assert abs(sum((r.k1 % 7 + 1) * r.up for r in rows) - 0.4 * sum(k % 7 + 1 for k in range(600))) < 7


def test_mixing_of_long_texts(spark, docs):
    rows = mixing.mix(docs(["w " * 300_000, "x", None, "y " * 100])).collect()
    assert {r.id: r.size for r in rows} == {0: 300_000, 1: 1, 2: 0, 3: 100} and all(0 <= r.copies <= 3 for r in rows)


def test_token_counts_are_those_of_the_library(spark, docs, none):
    texts = [*odd_texts(), "word " * 50_000]
    versions = tokens.query_versions()
    encs = {v: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}) for v, (path, pattern) in versions.items()}
    got = {r.doc_id: r for r in tokens.counted(docs(texts), versions, keep=("doc_id", "lang")).collect()}
    assert all(got[i][v] == len(e.encode_ordinary(t or "")) for i, t in enumerate(texts) for v, e in encs.items())
    assert tokens.counted(none, versions, keep=("doc_id",)).count() == 0
    with pytest.raises(ValueError):
        tokens.counted(none, {"a": ("x", "p"), "b": ("y", "q")})


def test_query_totals_equal_a_plain_count(spark, sf):
    totals = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in tokens.op5_tokens(spark, sf).collect()}
    versions = tokens.query_versions()
    encs = {v: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={}) for v, (path, pattern) in versions.items()}
    one, two = versions
    want, seen = defaultdict(lambda: [0, 0]), set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        for v in (one, two):
            if v == two or r.text not in seen:
                x = want[r.source, r.lang, v]
                x[0] += 1
                x[1] += len(encs[v].encode_ordinary(r.text))
        seen.add(r.text)
    assert totals == {k: tuple(x) for k, x in want.items()}


@pytest.mark.parametrize("lost", ["the ids", "the mark", "the first delete", "the second delete"])
def test_folding_survives_a_lost_driver(spark, docs, tmp_path, monkeypatch, lost):
    """The driver is lost at some step of a fold: totals stay, batches aren't applied again, and the next fold ends it."""
    path = str(tmp_path / "r")
    store = tokens.Rollup(spark, path)
    batches = [tokens.changes(docs([f"a {i}", "b"]), "insert", "v1", F.lit(5 + i)) for i in range(3)]
    for i, b in enumerate(batches[:2]):
        assert store.apply(str(i), b)
    read = lambda: sorted(map(str, tokens.Rollup(spark, path).totals().collect()))
    before = read()

    class Lost(Exception):
        pass

    if lost == "the ids":
        kept = spark.createDataFrame
        monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: (_ for _ in ()).throw(Lost()) if a[1:] == ("batch string",) else kept(*a, **b))
    else:
        real, at = store._fs, {"the mark": -1, "the first delete": 0, "the second delete": 1}[lost]

        class Broken:
            deletes = 0

            def __getattr__(self, name):
                if name == "create" and at < 0:
                    raise Lost
                if name == "delete" and at >= 0:
                    Broken.deletes += 1
                    if Broken.deletes > at + 1:  # the first call clears the new folder
                        raise Lost
                return getattr(real, name)

        store._fs = Broken()
    with pytest.raises(Lost):
        store.compact()
    monkeypatch.undo()
    assert read() == before
    again = tokens.Rollup(spark, path)
    assert not again.apply("0", batches[0]) and not again.apply("1", batches[1]) and read() == before
    assert again.apply("2", batches[2])
    after = read()
    again.compact()
    assert read() == after != before and again.folders() == [] and not again.apply("1", batches[1])
    again.compact()
    assert read() == after and len(again._names()) == 1
    again.drop()
    assert again._names() == []


def test_rollup(spark, docs, none, tmp_path):
    store = tokens.Rollup(spark, str(tmp_path / "r"))
    df = docs(["a b", "c", None, ""])
    one = tokens.changes(df, "insert", "v1", F.size(F.split("text", " ")).cast("long"))
    assert store.apply("1", one) and not store.apply("1", one)
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    first = total()
    assert first[(None, None, "v1")] == (1, 0) or first[(None, None, "v1")][0] == 1
    store.apply("2", tokens.changes(df.limit(1), "revise", "v1", F.lit(7), F.lit(2)))
    assert total()[("a", "en", "v1")][1] == first[("a", "en", "v1")][1] + 5
    store.apply("3", tokens.changes(df.limit(1), "delete", "v1", F.lit(7)))
    assert total()[("a", "en", "v1")][0] == first[("a", "en", "v1")][0] - 1
    assert store.apply("4", tokens.changes(none, "insert", "v1", F.lit(1)))
    before = total()
    store.compact()
    assert total() == before and store.folders() == [] and store.generation()
    assert not store.apply("2", one) and not store.apply("4", one) and total() == before
    assert store.apply("5", one) and total() != before
    with pytest.raises(Exception, match="unknown kind"):
        store.apply("6", one.withColumn("kind", F.lit("odd")))
    assert not any("batch-6" in f for f in store.folders())


def test_written_pages_vary():
    pages = [html_pages.Writer(s).page()[0] for s in range(3)]
    assert len(set(pages)) == 3 and html_pages.Writer(0).page()[0] == pages[0]
