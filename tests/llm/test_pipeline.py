"""Each stage on its own input, against a plain form of its decision."""

import corpus_pipeline as pipeline
import tiktoken

from lexweave.llm import bpe, toxicity
from test_dedup import brute_near, brute_substring


def test_stages(spark, sf, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        assert k == len(pipeline.STAGES) - 1 or docs.columns == columns
    given = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(given, spark.read.parquet(f"{sf}/labels.parquet"), may_learn=toxicity.learnable())
    clean = {r.id for r in toxicity.score(given, model).collect() if r.predicted == 0}
    one = {r.doc_id: r for r in kept[0].collect()}
    assert set(one) == clean
    near = brute_near([(i, r.text) for i, r in one.items()], 5)
    two = {r.doc_id: r for r in kept[1].collect()}
    assert set(two) == {i for i, v in near.items() if v[3]} and all(two[i] == one[i] for i in two)
    order = sorted(two)
    cut = brute_substring([two[i].text for i in order])
    three = {r.doc_id: r for r in kept[2].collect()}
    assert set(three) == set(two)
    for n, i in enumerate(order):
        assert len((three[i].text or "").encode().split()) == cut[n][1] - cut[n][2]
        assert three[i].n_chars == len(three[i].text)
        assert cut[n][2] or three[i] == two[i]
    four = kept[3].collect()
    assert {r.doc_id for r in four} <= set(three) and all(r == three[r.doc_id] for r in four)
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    five = kept[4].collect()
    assert len(five) == len(four) and all(r.ids == enc.encode_ordinary(three[r.doc_id].text) for r in five[:200])


def test_empty_and_odd(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "text a", "en", "s", 6), (2, "", None, "s", 0), (3, "text b", "en", "s", 6), (3, "text b", "en", "s", 6), (3, "quite another text", "en", "s", 18)], "doc_id long, text string, lang string, source string, n_chars long")
    docs, seen = odd, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"odd{k}"))
        docs = spark.read.parquet(str(tmp_path / f"odd{k}"))
        seen.append(sorted((str(r.doc_id), *(str(r[c]) for c in ("text", "n_chars") if c in docs.columns)) for r in docs.collect()))
    given = sorted((str(r.doc_id), str(r.text), str(r.n_chars)) for r in odd.collect())
    once = sorted(set(given))
    assert seen[0] == given
    # of two equal rows one stays; an id's other text is another document
    assert seen[1] == once
    assert [(i, t) for i, t, _ in seen[2]] == [(i, t) for i, t, _ in once]
    # one source holds all words, so every text is taken once and texts without words never
    assert [(i, t) for i, t, _ in seen[3]] == [(i, t) for i, t, _ in once if t not in ("None", "")]
    assert [i for i, in seen[4]] == [i for i, *_ in seen[3]]
