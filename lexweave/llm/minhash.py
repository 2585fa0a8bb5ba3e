"""Near-duplicate documents: MinHash, banding, verification, components.

1. One scan hashes each text's distinct word shingles and keeps, per row, the
   set's size, a 128-bit fingerprint of the set, the minima of many universal
   hash functions (one byte of each, the signature) and a key per band of minima.
2. Rows with equal sets become one class, a node with a number of its own, stood
   for by its least id.
3. Classes that share a band key are candidates.  Each is compared with the
   least member of its bucket; links confirmed on full sets give components.
4. Buckets whose members still lie in several components are compared in
   blocks, only across components and only where set sizes allow the similarity, by
   signature and then on full sets.  So every candidate pair that could join two
   components is judged, none is emitted, and a bucket of n linked copies costs
   n comparisons.  A bucket of n members of like size that don't link is copied
   once for each ``BLOCK`` of them.
5. Classes that hold one id are joined.

With 32 bands of 6 minima a pair of similarity 0.8 is missed with probability
6e-5, one of 0.85 with 3e-7.  Nothing is capped.

Null and empty texts have no shingles and link with nothing.  A text with fewer
words than a shingle is one shingle.  Rows that repeat an id are one document: what
links with any of them is in its component, and all of them have that component.
A row with a null id keeps a null component.  Empty tables give empty results.
Ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, coefficients, cut, mix64, run_hash, slices, table, text_buffers
from .components import components

BANDS, ROWS = 32, 6
#: Members of a block of a bucket that is compared across components.
BLOCK = 256
#: Least share of equal signature bytes of a pair to confirm, 5.5 deviations under 0.8.
SLACK = 0.16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, rows one after another; and where each row begins."""
    w = Words(data, offsets, lower=True)
    n_rows = len(offsets) - 1
    count = np.diff(w.begin)
    place = np.arange(len(w)) - w.begin[w.row]
    full = np.flatnonzero(place + words <= count[w.row])
    row, value = [w.row[full]], [run_hash(w.hash[0], full, words, 11)]
    for length in range(1, words):
        short = w.begin[:-1][count == length]
        row.append(w.row[short])
        value.append(run_hash(w.hash[0], short, length, 11 + length))
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(n_rows + 1))


def minima(values: np.ndarray, begin: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of ``hashes`` multiply-add-shift functions over each row's non-empty set."""
    low = values & np.uint64(0xFFFFFFFF)
    a, b = coefficients(hashes, 101), coefficients(hashes, 202)
    out = np.empty((hashes, len(begin)), dtype=np.uint64)
    for k in range(hashes):
        out[k] = np.minimum.reduceat((low * a[k] + b[k]) >> np.uint64(32), begin)
    return out


def fingerprints(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each row's set; 0 for empty ones."""
    out = []
    for mixed in (mix64(values), mix64(values * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))):
        sums = np.zeros(len(begin) - 1, np.uint64)
        some = np.flatnonzero(np.diff(begin))
        if len(some):
            sums[some] = np.add.reduceat(mixed, begin[:-1][some])
        out.append(sums.view(np.int64))
    return out[0], out[1]


def signatures(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, n, s1, s2 (fingerprint of the set), bands array<long>, sig binary."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                values, begin = shingle_sets(data, offsets[i : j + 1], words)
                n = np.diff(begin)
                some = np.flatnonzero(n)
                s1, s2 = fingerprints(values, begin)
                keys, sig = [None] * (j - i), [None] * (j - i)
                if len(some):
                    at = begin[:-1][some]
                    m = minima(values, at, bands * rows)
                    key = np.empty((len(some), bands), dtype=np.uint64)
                    for k in range(bands):
                        key[:, k] = run_hash(m[k * rows : (k + 1) * rows].T.reshape(-1), np.arange(len(some)) * rows, rows, 1000 + k)
                    sigs = np.ascontiguousarray(mix64(m).astype(np.uint8).T)
                    for r, q in enumerate(some):
                        keys[q], sig[q] = key[r].view(np.int64), sigs[r].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n", "s1", "s2", "bands", "sig"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n long, s1 long, s2 long, bands array<long>, sig binary")


def full_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Per row: id, s1, s2 as of ``signatures``, and the whole set, as sorted 64-bit hashes in one binary."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                values, begin = shingle_sets(data, offsets[i : j + 1], words)
                s1, s2 = fingerprints(values, begin)
                sets = [values[begin[r] : begin[r + 1]].tobytes() for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s1), pa.array(s2), pa.array(sets, pa.binary())], names=["id", "s1", "s2", "set"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, s1 long, s2 long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union, by signature, then in full."""
    one = sets.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("sig_a", "sig_b", "set_a", "set_b")]
            for i in range(batch.num_rows):
                ga, gb, sa, sb = (np.frombuffer(c[i].as_buffer(), dtype=t) for c, t in zip(cols, (np.uint8, np.uint8, np.uint64, np.uint64), strict=True))
                p, q = sorted((len(sa), len(sb)))
                if 100 * p < percent * q or np.mean(ga == gb) < percent / 100 - SLACK:
                    continue
                both = np.sort(np.concatenate((sa, sb)), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (p + q - common):
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["a", "b"])

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b")
    return rows.mapInArrow(run, "a long, b long")


def across(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components of one bucket, enough of them to join what is linked.

    ``members`` has (key, band, node, component), ``sigs`` (node, size, sig, bands).  The
    members outside the pivot's component meet each other and those inside, block
    against block.  Sizes fall into steps of a factor 100 / ``percent``; members more than one
    step apart can't be similar enough, so a block meets those of its own step and the next
    ones only.  First by signature: a pair counts in the first band whose key it
    shares, so in one bucket only, and each block passes on the members that have a
    near partner, never the pairs.  Then their full sets are compared, as a product of incidence
    matrices, and a block passes on links that join components, fewer than members.
    """
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(max(100 / percent, 1.0001)) + 1e-9).cast("int")
    per = cut(members.groupBy("key").agg(F.min_by("component", "node").alias("main")))
    rows = cut(members.join(per, "key").join(sigs.select("node", step.alias("step")), "node").select("key", "band", "node", "component", (F.col("component") != F.col("main")).alias("minor"), "step"))
    # blocks of each bucket, side and step; a bucket has as many steps as its sizes have, whatever its members
    counts = rows.groupBy("key", "minor", "step").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    blocks = cut(counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("minor", "step"), "k"))).alias("blocks")))
    rows = rows.join(blocks, "key").join(sigs, "node")
    of = lambda minor, step: F.coalesce(F.try_element_at("blocks", F.struct(minor.alias("minor"), step.cast("int").alias("step"))), F.lit(0))
    own = F.col("step")
    s = F.pmod(F.xxhash64("node", "key"), of(F.col("minor"), own)).cast("int")
    at = lambda kind, p, i, q, j: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), i.cast("int").alias("i"), q.cast("int").alias("q"), j.cast("int").alias("j"))
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    near = F.array(own - 1, own, own + 1)
    yes, no = F.lit(True), F.lit(False)
    # kind a: a block outside the pivot's component (p, i) and one inside (q, j); kind m: two outside, the lower first
    out_in = F.flatten(F.transform(near, lambda q: F.transform(to(of(no, q)), lambda j: at("a", own, F.col("s"), q, j))))
    in_out = F.flatten(F.transform(near, lambda p: F.transform(to(of(yes, p)), lambda i: at("a", p, i, own, F.col("s")))))
    below = lambda q, j: (q < own) | ((q == own) & (j < F.col("s")))
    out_out = F.flatten(F.transform(near, lambda q: F.transform(to(of(yes, q)), lambda j: F.when(below(q, j), at("m", q, j, own, F.col("s"))).otherwise(at("m", own, F.col("s"), q, j)))))
    tasks = F.when(F.col("minor"), F.concat(out_in, out_out)).otherwise(in_out)
    task = ["key", "kind", "p", "i", "q", "j"]
    dealt = rows.withColumn("s", s).withColumn("task", F.explode(tasks)).select("key", "band", "task.kind", "task.p", "task.i", "task.q", "task.j", "node", "component", "size", "sig", "bands", "minor", "step", "s")

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        kind, p, i, q, j = (group[c][0].as_py() for c in task[1:])
        if kind == "a":
            left = group["minor"].to_numpy(zero_copy_only=False).astype(bool)
            return np.flatnonzero(left), np.flatnonzero(~left)
        left = (group["s"].to_numpy() == i) & (group["step"].to_numpy() == p)
        return np.flatnonzero(left), np.flatnonzero(left if (p, i) == (q, j) else ~left)

    def apart(group: pa.Table, li: np.ndarray, ri: np.ndarray) -> np.ndarray:
        _, comp = np.unique(group["component"].to_numpy(zero_copy_only=False), return_inverse=True)
        size = group["size"].to_numpy()
        return (comp[li][:, None] != comp[ri][None, :]) & (100 * np.minimum.outer(size[li], size[ri]) >= percent * np.maximum.outer(size[li], size[ri]))

    def screen(group: pa.Table) -> pa.Table:
        li, ri = sides(group)
        band = group["band"][0].as_py()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), dtype=np.uint8).reshape(group.num_rows, -1)
        keys = group["bands"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        hit = np.zeros(group.num_rows, dtype=bool)
        x, y = np.nonzero(apart(group, li, ri))
        for q in range(0, len(x), 50_000):
            xx, yy = li[x[q : q + 50_000]], ri[y[q : q + 50_000]]
            near = (sig[xx] == sig[yy]).mean(axis=1) >= percent / 100 - SLACK
            near[near] = (keys[xx[near]] == keys[yy[near]]).argmax(axis=1) == band
            hit[xx[near]] = True
            hit[yy[near]] = True
        return group.filter(pa.array(hit)).select([*task, "node", "component", "size", "minor", "step", "s"])

    def settle(group: pa.Table) -> pa.Table:
        li, ri = sides(group)
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["set"].combine_chunks()]
        doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        value, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = times[col] > 1
        doc, col = doc[keep], col[keep]
        common = np.zeros((len(li), len(ri)), dtype=np.float32)
        place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
        place_l[li], place_r[ri] = np.arange(len(li)), np.arange(len(ri))
        order = np.argsort(col, kind="stable")
        doc, col = doc[order], col[order]
        for low in range(0, len(value), 4096):
            u, v = np.searchsorted(col, (low, low + 4096))
            if u == v:
                continue
            d, c = doc[u:v], col[u:v] - low
            one, two = np.zeros((len(li), 4096), np.float32), np.zeros((len(ri), 4096), np.float32)
            p, q = place_l[d] >= 0, place_r[d] >= 0
            one[place_l[d[p]], c[p]] = 1
            two[place_r[d[q]], c[q]] = 1
            common += one @ two.T
        size = group["size"].to_numpy()
        both = common.astype(np.int64)
        x, y = np.nonzero(apart(group, li, ri) & (100 * both >= percent * (size[li][:, None] + size[ri][None, :] - both)))
        ids, comps = group["node"].combine_chunks(), group["component"].to_pylist()
        over: dict = {}

        def root(c):
            while c in over:
                c = over[c]
            return c

        a, b = [], []
        for i, j in zip(li[x].tolist(), ri[y].tolist(), strict=True):
            p, q = root(comps[i]), root(comps[j])
            if p != q:
                over[p] = q
                a.append(i)
                b.append(j)
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    # little data and much work a row: dealt by number, which adaptive execution leaves as it is
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = "key long, kind string, p int, i int, q int, j int, node long, component long, size long, minor boolean, step int, s int"
    held = dealt.repartition(n, *task).groupBy(*task).applyInArrow(screen, kept).join(sets.select("node", "set"), "node")
    return held.repartition(n, *task).groupBy(*task).applyInArrow(settle, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``df``: id_col, n_shingles, component_id, kept."""
    base = cut(signatures(df, id_col, text_col, words, bands, rows))
    some = base.where("n > 0 and id is not null")
    same = ["s1", "s2"]
    twice = cut(some.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"))
    repeats = not twice.isEmpty()
    reps = some.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("n", "bands", "sig"), "id").alias("v"))
    reps = cut(reps.select(F.monotonically_increasing_id().alias("node"), *same, "rep", "copies", "v.*"))
    keys = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("pivot")).where("c > 1").select("key", "pivot")
    members = cut(keys.join(buckets, "key"))
    nodes = members.select("node").distinct()
    sigs = reps.select("node", F.col("n").alias("size"), "sig", "bands")
    wanted = reps.join(nodes, "node").select("node", "rep", *same, "sig", F.col("n").alias("size"))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = full_sets(texts, "id", "text", words).withColumnRenamed("id", "rep")
    if repeats:
        sets = sets.dropDuplicates(["rep", *same])
    sets = cut(sets.join(wanted, ["rep", *same]).select("node", "size", "sig", "set"))
    stars = members.where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    first = cut(components(confirm(stars, sets, percent)))
    named = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = cut(named.select("key", "band", "node", "component"))
    per = cut(facts.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"))
    # written first, so that what is counted by bucket is combined map-side
    second = cut(across(cut(facts.join(per, "key")), sigs, sets, percent))
    if repeats:
        # classes that hold one id: (node of a further class, node of its first class)
        held = cut(some.join(twice, "id").select("id", *same).distinct().join(reps.select("node", *same), same).select("id", "node"))
        second = second.unionByName(held.join(held.groupBy("id").agg(F.min("node").alias("least")), "id").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    names = first.select("node", "component")
    ends = second.join(names.toDF("a", "ca"), "a", "left").join(names.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(ends)
    whole = names.toDF("node", "c1").join(merged.toDF("c1", "c2"), "c1", "left").select("node", F.coalesce("c2", "c1").alias("c"))
    lone = merged.toDF("node", "c").join(names.select("node"), "node", "left_anti")
    whole = cut(whole.unionByName(lone).join(reps.select("node", "rep", *same), "node"))
    least = whole.groupBy("c").agg(F.min("rep").alias("component"))
    # classes that are in a group or have copies; all other rows are on their own
    grouped = whole.join(least, "c").select(*same, "component")
    copied = reps.where("copies > 1").select(*same, "rep")
    out = base.select("id", "n", *same).join(copied, same, "left").join(grouped, same, "left")
    out = out.withColumn("component", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep", "id")))
    if repeats:
        # a repeated id has one component in all its rows, also in those without a shingle
        again = out.join(twice, "id", "left_semi").groupBy("id").agg(F.min("component").alias("of_id"))
        out = out.join(again, "id", "left").withColumn("component", F.coalesce("of_id", "component"))
    out = out.withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


#: Brute force over shared shingles; reachability by a recursive query.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
