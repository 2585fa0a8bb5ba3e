"""Properties and small cases of the operators."""

import subprocess
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from lexweave.operators import crawl, deps, lexical, profiling, search, store, versions
from lexweave.plans import catalog, streams
from lexweave.sources import bind, readers
from lexweave.streaming import ingest


def chunks(spark, texts):
    return spark.createDataFrame([("l", "1", k, v) for k, v in texts.items()], "library_id string, version string, id string, content string")


def test_bm25_case(spark):
    c = chunks(spark, {"a": "Use MoveLinear to start the move.", "b": "Coordinate motion is described elsewhere.", "c": "MoveLinear parameters control velocity."})
    q = spark.createDataFrame([("q", "MoveLinear")], "query_id string, query string")
    got = {r.chunk_id: r.bm25 for r in lexical.score(lexical.postings(c), lexical.lengths_of(c), q).collect()}
    assert set(got) == {"a", "c"} and all(v > 0 for v in got.values())


def test_index_properties(spark, sf):
    c = bind.chunks(spark, sf)
    p = lexical.postings(c)
    a = {r.chunk_id: r.doc_length for r in lexical.doc_lengths(p).collect()}
    assert a == {r.chunk_id: r.doc_length for r in lexical.lengths_of(c).collect()}
    shards = lexical.sharded(p).select("term", "shard_index").distinct()
    assert shards.count() == p.select("term").distinct().count()
    assert shards.agg(F.min("shard_index"), F.max("shard_index")).first() == (0, 63)


def test_filter_reaches_the_files(spark, sf, capsys):
    bind.read(spark, sf, "documents").where("source = 'src1'").select("doc_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(source,src1)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_cosine_is_symmetric(spark):
    f = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 1.0, -1.0])], "a array<float>, b array<float>")
    x, y = f.select(search.cosine(F.col("a"), F.col("b")), search.cosine(F.col("b"), F.col("a"))).first()
    assert x == y


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    once = store.upsert(old, new, ["k"], "n")
    twice = store.upsert(once, new, ["k"], "n")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_rename_and_outcomes(spark, sf):
    libs = bind.libraries(spark, sf)
    assert versions.rename_outcome(libs, "nope", "x").first()[0] == "NotFound"
    assert versions.rename_outcome(libs, "src1", "src2").first()[0] == "Collision"
    assert versions.rename_outcome(libs, "src1", "x").first()[0] == "Renamed"
    out = versions.rename(bind.chunks(spark, sf), "src1", "x")
    assert out.where("library_id = 'src1' or id like 'src1/%'").isEmpty()


def test_delete_last_version_drops_the_library(spark):
    libs = spark.createDataFrame([("l", "1")], "id string, current_version string")
    v = spark.createDataFrame([("l", "1", 1)], "library_id string, version string, scraped_at int")
    out = versions.delete_version({"libraries": libs, "library_versions": v}, "l", "1")
    assert out["libraries"].isEmpty() and out["library_versions"].isEmpty()


def test_limiter_batch_equals_fold(spark):
    rows = [("a", i, float(i), 429 if i % 40 == 39 else 200, None) for i in range(200)] + [("b", i, float(i), 500 if i % 2 else 200, 7.0) for i in range(30)]
    log = spark.createDataFrame(rows, "host string, seq int, at double, status int, retry_after double")
    got = {(r.host, r.seq): (r.concurrency, r.until) for r in crawl.limit_hosts(log).collect()}
    for host in "ab":
        m = crawl.Limiter()
        for _, seq, at, status, after in sorted(r for r in rows if r[0] == host):
            assert got[host, seq] == m.step(status, at, after)
    assert crawl.Limiter().step(503, 0.0)[0] == 2


def test_cycle_ends(spark):
    g = spark.createDataFrame([("https://a.com/1", "https://a.com/2"), ("https://a.com/2", "https://a.com/1")], "src string, link string")
    assert crawl.crawl(g, "https://a.com/1").count() == 2


def test_crawl_follows_paths_of_any_length(spark):
    """In-scope pages set the other depths back, so pages within the limits lie 24 links from the root."""
    path = ["https://a.com/g/", *[f"https://a.com/{'g/' if k % 3 == 0 else 'o/'}{k}" for k in range(1, 25)]]
    g = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "src string, link string")
    assert {r.url for r in crawl.crawl(g, path[0]).collect()} == set(path)


def test_status_and_stale(spark):
    j = spark.createDataFrame([("a", "Running", "2024-01-01 00:00:00", None), ("b", "Running", "2024-01-01 00:00:01", None), ("c", "Running", "2024-01-01 00:00:00", "2024-01-01 03:00:00")], "id string, status string, created_at string, last_progress_at string").withColumns({"created_at": F.to_timestamp("created_at"), "last_progress_at": F.to_timestamp("last_progress_at")})
    now = F.lit("2024-01-01 04:00:01").cast("timestamp")
    assert {r.id for r in j.where(profiling.stale(j, now)).collect()} == {"a"}


def test_files(spark, tmp_path):
    (tmp_path / "proj" / "node_modules").mkdir(parents=True)
    (tmp_path / "proj" / "README.md").write_text("# hi")
    (tmp_path / "proj" / "big.txt").write_text("x" * 300_000)
    (tmp_path / "proj" / "requirements.txt").write_text("requests==2\n")
    (tmp_path / "proj" / "node_modules" / "package.json").write_text('{"dependencies": {"a": "1"}}')
    pages = readers.repository(spark, str(tmp_path / "proj"), "o", "r").collect()
    assert {p.title: p.category for p in pages} == {"README.md": "Overview", "requirements.txt": "Code"}
    got = deps.parse_manifests(readers.manifests(spark, str(tmp_path / "proj"))).collect()
    assert [(r.package_id, r.version) for r in got] == [("requests", "2")]


def test_catalog_replaces_a_partition(spark, tmp_path):
    c = store.Catalog(spark, str(tmp_path / "t"))
    row = lambda v, x: spark.createDataFrame([("l", v, x)], "library_id string, version string, x string")
    c.append("chunks", row("1", "a"))
    c.append("chunks", row("2", "b"))
    c.replace("chunks", row("2", "c"))
    assert {r.x for r in c.read("chunks").collect()} == {"a", "c"}


def test_stream_equals_batch(spark, sf, tmp_path):
    pages = bind.pages(spark, sf).drop("doc_id", "lang")
    src = str(tmp_path / "pages")
    pages.repartition(6).write.parquet(src)
    q = ingest.ingest(ingest.page_stream(spark, src, 2), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    from lexweave.operators.chunking import chunk_pages

    want = {(r.id, r.content) for r in chunk_pages(pages).collect()}
    got = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert {(r.id, r.content) for r in got.collect()} == want and got.count() == len(want)
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).select("batch").distinct().count() == 3


def test_stream_limits_equal_batch(spark, tmp_path):
    rows = pd.DataFrame({"host": ["a", "b"] * 40, "seq": range(80), "at": [float(i) for i in range(80)], "status": [429 if i % 17 == 0 else 200 for i in range(80)], "retry_after": [float("nan")] * 80})
    log = spark.createDataFrame(rows, "host string, seq int, at double, status int, retry_after double")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    q = ingest.host_limits(s).writeStream.format("memory").queryName("limits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, crawl.limit_hosts(log).collect()))


def test_catalog_writes_in_place(spark, tmp_path):
    """Upserts read what they overwrite; deletes say how many rows went; a version stays a text."""
    c = store.Catalog(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(r, "library_id string, version string, id string, x int")
    c.append("chunks", rows(("l", "2.10", "a", 1), ("l", "2.10", "b", 2), ("m/n", "1", "c", 3)))
    for _ in range(2):
        c.upsert("chunks", rows(("l", "2.10", "b", 5), ("l", "2.10", "d", 6)), ["id"])
    got = lambda: sorted((r.library_id, r.version, r.id, r.x) for r in c.read("chunks").collect())
    assert got() == [("l", "2.10", "a", 1), ("l", "2.10", "b", 5), ("l", "2.10", "d", 6), ("m/n", "1", "c", 3)]
    assert c.delete("chunks", rows(("m/n", "1", "", 0), ("l", "9", "", 0))) == 1 and c.delete("chunks", rows(("m/n", "1", "", 0))) == 0
    assert [r[2] for r in got()] == ["a", "b", "d"]


def test_vector_index_replaces_and_adds(spark, tmp_path):
    index = store.VectorIndex(spark, str(tmp_path / "v"))
    assert index.read().count() == 0
    rows = lambda v, *ids: spark.createDataFrame([(i, "HowTo", x, "l", v) for i, x in ids], "id string, category string, embedding array<float>, library_id string, version string")
    index.load(rows("1", ("a", [3.0, 4.0]), ("z", [0.0, 0.0]), ("n", None)))
    assert [(r.id, r.unit) for r in index.read().collect()] == [("a", [0.6, 0.8])]
    index.load(rows("1", ("b", [1.0, 0.0])))
    for _ in range(2):
        index.add(rows("1", ("c", [0.0, 2.0])))
    index.load(rows("2", ("d", [1.0, 1.0])))
    assert sorted(r.id for r in index.read().collect()) == ["b", "c", "d"]
    index.reload(rows("2", ("d", [1.0, 1.0])).unionByName(rows("1", ("b", [1.0, 0.0]))), spark.createDataFrame([("l", "2")], "id string, current_version string"))
    assert [r.id for r in index.read().collect()] == ["d"]


def test_stored_index_equals_a_scan(spark, sf, tmp_path):
    c = bind.chunks(spark, sf)
    index = lexical.Index(spark, str(tmp_path / "i")).build(c)
    q = spark.createDataFrame([("q", "The thing of Axis")], "query_id string, query string")
    want = {r.chunk_id: round(r.bm25, 9) for r in lexical.score(lexical.postings(c), lexical.lengths_of(c), q).collect()}
    assert want == {r.chunk_id: round(r.bm25, 9) for r in index.score(q).collect()} == {r.chunk_id: round(r.bm25, 9) for r in index.score_text("The thing of Axis").collect()}
    asked = index.postings(["the", "thing"])
    assert {r.term for r in asked.select("term").distinct().collect()} <= {"the", "thing"}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "shard_index" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in plan.split("PushedFilters")[1]
    assert "Exchange" not in lexical.postings(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source library_id", "lang version", "text content", "'x' id"))._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_numbered_within_a_version(spark):
    from lexweave.operators.symbols import numbered

    rows = [(lib, v, f"{k:04}") for lib, v, n in (("a", "1", 300), ("a", "2", 1), ("b", "1", 50)) for k in range(n)]
    got = {tuple(r)[:3]: r.ix for r in numbered(spark.createDataFrame(rows, "library_id string, version string, id string")).collect()}
    assert got == {r: int(r[2]) for r in rows}


def test_candidates_of_a_text():
    from lexweave.operators.symbols import candidates

    got = candidates("class Foo, eclass Bar; enum  K9 x1class Baz a.b(c) std::vec<int> foo-bar p->q éclass Qux Foo Foo(")
    assert [(n, k) for n, *_, k in got if k] == [("Foo", "class"), ("K9", "enum"), ("Baz", "class")]
    by = {(n, c, g): (leaf, box) for n, leaf, box, c, g, _ in got}
    assert by["a.b", True, False] == ("b", "a") and by["std::vec", False, True] == ("vec", "std") and by["p->q", False, False] == ("q", "p")
    assert ("Foo", True, False) in by and by["foo-bar", False, False] == ("foo-bar", None) and candidates(None) == []


def test_shared_folder_is_the_sessions(spark):
    from lexweave.session import shared_folder

    assert shared_folder(spark) == spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_repository_in_archives_is_read_as_one_checked_out(spark, tmp_path):
    """Odd names and texts, more files than an archive holds, and archives that any tool can read."""
    long = "é" * 60 + "/" + "n" * 120
    some = [("docs/a.md", "x\n"), (f"docs/{long}.txt", "ä\x00\U0001f600"), ("src/empty.py", ""), ("src/none.py", None), ("src/block.py", "b" * 512), ("src/over.py", "o" * (200 * 1024 + 1)), ("src/most.py", "m" * (200 * 1024)), ("node_modules/x/y.js", "hidden"), ("src/picture.png", "p")]
    some += [(f"samples/{i}.txt", f"text {i}\n" * (i % 7)) for i in range(40)]
    loose = tmp_path / "loose"
    for name, text in some:
        p = loose / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes((text or "").encode())
    readers.write_archives(spark.createDataFrame(some, "path string, value string").coalesce(1), f"{tmp_path}/packed", most=16)
    archives = sorted((tmp_path / "packed").glob("part-*"))
    assert len(archives) == 4
    assert sum(len([n for n in subprocess.run(["tar", "tf", a], capture_output=True, check=True, text=True).stdout.split("\n") if n and n != "./"]) for a in archives) == len(some)
    want = readers.repository(spark, f"file:{loose}", "o", "r").collect()
    got = readers.repository(spark, f"{tmp_path}/packed", "o", "r", archives=True).collect()
    hidden = {"src/over.py", "node_modules/x/y.js", "src/picture.png"}
    assert sorted(got) == sorted(want) and {r.title: r.raw_content for r in got} == {n: x for n, x in some if x and n not in hidden}


def test_git_source_on_odd_documents(spark, tmp_path):
    """No file for a document without a text, one for each row of a repeated or missing id, no folder or file in the file system for each."""
    rows = [(1, "a b", "en"), (1, "c", "en"), (None, "d", "en"), (None, "é\n\x00", "en"), (2, None, "de"), (3, "", "de"), (4, "x" * 204_799, "fr"), (5, "x" * 204_800, "fr"), (6, "z", None), (7, "z", "es")]
    rows += [(100 + i, f"text {i}", "fr") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    kept = streams.drop_folder
    streams.drop_folder = lambda s, path: made.extend(Path(path.removeprefix("file:")).rglob("part-*")) or kept(s, path)
    try:
        got = sorted(map(tuple, streams.s8(spark, str(tmp_path)).collect()))
    finally:
        streams.drop_folder = kept
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLES["s8_git_source"]).fetchall())
    assert 0 < len(made) < 20
