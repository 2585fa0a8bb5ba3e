"""Near-duplicate vectors by cross-polytope hashing, multiprobe, and verification.

A table of the index turns a unit vector by random sign changes and fast Hadamard
transforms, twice over, and names the nearest of the 2d signed axes; two such
names and the label make a bucket.  Each vector stands in its own bucket of each
table and probes the ``PROBES`` next likely ones, by how little its coordinates
fall short.  Two vectors meet where one's bucket is among the other's.

Vectors that are equal, component by component, under one label are one class, which is
hashed and compared once, as the least id; its size weighs its links.

Every meeting is verified by the cosine in double precision, as a block product.
A pair that meets in several places counts in one: the first table where it meets,
and there in the bucket of the smaller id, if the other reaches it.  So links are
counted exactly and no pair is emitted.  Buckets of over ``BLOCK`` rows are dealt as
blocks against blocks, so a large group of near copies is spread over many tasks.
With 64 dimensions a pair at cosine 0.98 meets in one table with a probability of
0.988, with 2 to 1,024 dimensions with 0.95 or more (measured in the tests), so in
none of the tables with about 2e-8 and 6e-6.

Rows without a label or with a null, zero, non-finite or partly null vector link
with nothing.  Vectors of different lengths never link.  Rows that repeat an id count as
one vector, the least by label and components.  A null id is a row of its own kind
with no links and no component.  Empty tables give empty results; only id,
vector and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coefficients, cut, mix64, table
from .components import components

TABLES, PROBES = 4, 8
BLOCK = 512
#: Candidates per name of a bucket: own axis and runners-up.
RUNNERS = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    for k in range(3):
        signs = 1.0 - 2.0 * ((mix64(coefficients(x.shape[1], 1 + 3 * seed + k)) >> np.uint64(33)) & np.uint64(1)).astype(float)
        x = hadamard(x * signs)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def padded(x: np.ndarray) -> np.ndarray:
    """Rows filled up with zeros to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def buckets(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes) of unit rows; the first is the row's own."""
    x = padded(x)
    n, d = x.shape
    r = min(RUNNERS, d)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        names, loss = [], []
        for h in range(2):
            y = rotate(x, 2 * t + h)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :r]
            best = np.take_along_axis(size, top, axis=1)
            names.append(2 * top + (np.take_along_axis(y, top, axis=1) < 0))
            loss.append((best[:, :1] - best) ** 2)
        both = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(n, -1)
        order = np.argsort(both, axis=1, kind="stable")[:, : 1 + probes]
        a, b = np.take_along_axis(names[0], order // r, axis=1), np.take_along_axis(names[1], order % r, axis=1)
        out[:, t, : order.shape[1]] = a * (2 * d) + b
        out[:, t, order.shape[1] :] = -1
    return out


def linked(ids: np.ndarray, x: np.ndarray, cosine: float, li: np.ndarray, ri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of li by ri) of different ids with at least the cosine; x: unit rows."""
    p, q = np.nonzero(x[li] @ x[ri].T >= cosine - 1e-9)
    p, q = li[p], ri[q]
    # the product may round otherwise than one dot product: near the bound, the latter decides
    ok = (ids[p] != ids[q]) & (np.einsum("ij,ij->i", x[p], x[q]) >= cosine)
    return p[ok], q[ok]


def counted(ids: np.ndarray, codes: np.ndarray, t: int, code: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each linked pair counts in this table and bucket."""
    own_p, own_q = codes[p, :, 0], codes[q, :, 0]
    reach_p = (codes[p] == own_q[:, :, None]).any(axis=2)  # p probes q's bucket, by table
    reach_q = (codes[q] == own_p[:, :, None]).any(axis=2)
    first = (reach_p | reach_q).argmax(axis=1) == t
    low_is_p = ids[p] < ids[q]
    low_own = np.where(low_is_p, own_p[:, t], own_q[:, t])
    high_own = np.where(low_is_p, own_q[:, t], own_p[:, t])
    high_reaches = np.where(low_is_p, reach_q[:, t], reach_p[:, t])
    return first & (np.where(high_reaches, low_own, high_own) == code)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """id_col, n_links, component_id and kept of every distinct id."""
    id_type, label_type = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    given = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    one = given.where("id is not null").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    nulls = given.where("id is null").select("id")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    linkable = one.where("label is not null and v is not null and size(v) > 0").where(finite).where(F.exists("v", lambda x: x != 0))
    every = cut(linkable.select("id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    same = ["label", "h1", "h2"]
    classes = cut(every.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    good = cut(every.join(classes, same).where("id = rep").select("id", "label", "v", "copies"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                vs = part.column(2)
                size = vs.value_lengths().to_numpy()
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    rows = part.take(pa.array(at))
                    flat = rows.column(2).flatten().to_numpy().reshape(len(at), d)
                    c = buckets(unit(flat), tables, probes)
                    n, per = len(at), tables * (1 + probes)
                    code = c.reshape(-1)
                    index = np.repeat(np.arange(n), per)
                    t = np.tile(np.repeat(np.arange(tables), 1 + probes), n)
                    own = np.tile(np.arange(1 + probes) == 0, n * tables)
                    keep = code >= 0
                    index = pa.array(index[keep])
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(index), rows.column(1).take(index), pa.array(np.full(len(index), d, np.int32)), pa.array(t[keep].astype(np.int32)), pa.array(code[keep]), pa.array(own[keep])], names=["id", "label", "d", "t", "code", "own"])

    where = cut(good.mapInArrow(place, f"id {id_type}, label {label_type}, d int, t int, code long, own boolean"))
    key = ["label", "d", "t", "code"]
    sizes = where.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("owners > 0 and n > 1")
    sizes = sizes.select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    rows = where.join(sizes, key).withColumn("s", F.pmod(F.xxhash64("id", "code", "t"), F.col("k")).cast("int"))
    rows = rows.join(good.select("id", "v", "copies"), "id")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(*key, F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "id", "own", "copies", "v")

    def meet(ids: np.ndarray, x: np.ndarray, own: np.ndarray, copies: np.ndarray, s: np.ndarray, t: int, code: int, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one block pair: indices of linked rows, their links counted here, the least row each is joined to."""
        li, ri = np.flatnonzero(s == i), np.flatnonzero(s == j)
        ps, qs = [], []
        for low in range(0, len(li), 128):
            p, q = linked(ids, x, cosine, li[low : low + 128], ri)
            met = (own[p] | own[q]) & ((p < q) if i == j else True)
            ps.append(p[met])
            qs.append(q[met])
        p, q = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (ps, qs))
        if not len(p):
            return p, p, p
        some, inverse = np.unique(np.concatenate((p, q)), return_inverse=True)
        p, q = inverse[: len(p)], inverse[len(p) :]
        here, weight = ids[some], copies[some]
        codes = buckets(x[some], tables, probes)
        n = np.zeros(len(some), dtype=np.int64)
        for low in range(0, len(p), 50_000):
            u, v = p[low : low + 50_000], q[low : low + 50_000]
            c = counted(here, codes, t, code, u, v)
            np.add.at(n, u[c], weight[v[c]])
            np.add.at(n, v[c], weight[u[c]])
        back = np.argsort(here, kind="stable")
        rank = np.argsort(back, kind="stable")
        return some, n, some[back[roots(len(some), rank[p], rank[q])[rank]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in chain(batches, [None]):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                rest = part if rest is None else pa.concat_tables([rest, part])
            if rest is None or not rest.num_rows:
                continue
            cols = {c: rest[c].combine_chunks() for c in rest.column_names}
            marks = [cols["label"].dictionary_encode().indices.to_numpy(zero_copy_only=False), *(cols[c].to_numpy(zero_copy_only=False) for c in ("d", "t", "code", "i", "j"))]
            change = np.zeros(rest.num_rows, dtype=bool)
            change[0] = True
            for m in marks:
                change[1:] |= m[1:] != m[:-1]
            begin = np.append(np.flatnonzero(change), rest.num_rows)
            groups = len(begin) - 1 - (batch is not None)  # the last group may go on in the next batch
            ids, own, s, copies = (cols[c].to_numpy(zero_copy_only=False) for c in ("id", "own", "s", "copies"))
            flat, offsets = cols["v"].values.to_numpy(zero_copy_only=False), cols["v"].offsets.to_numpy()
            index, links, to = [], [], []
            for g in range(groups):
                a, b = begin[g], begin[g + 1]
                if b - a < 2:
                    continue
                x = unit(flat[offsets[a] : offsets[b]].reshape(b - a, -1))
                got = meet(ids[a:b], x, own[a:b].astype(bool), copies[a:b], s[a:b], int(marks[2][a]), int(marks[3][a]), int(marks[4][a]), int(marks[5][a]))
                if len(got[0]):
                    index.append(a + got[0])
                    links.append(got[1])
                    to.append(a + got[2])
            if index:
                yield pa.RecordBatch.from_arrays([cols["id"].take(pa.array(np.concatenate(index))), pa.array(np.concatenate(links)), cols["id"].take(pa.array(np.concatenate(to)))], names=["id", "n", "to"])
            rest = rest.slice(begin[groups])

    dealt = rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    met = cut(dealt.select(*key, "i", "j", "s", "id", "own", "copies", "v").mapInArrow(run, f"id {id_type}, n long, to {id_type}"))
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(met.select(F.col("id").alias("a"), F.col("to").alias("b")))
    found = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked_rows = every.select("id", *same).join(found, same).select("id", "n_links", "component")
    out = one.select("id").join(linked_rows, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = out.unionByName(nulls.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))


SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)
  GROUP BY vec_id HAVING sum(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END) = 0 AND max(abs(x)) > 0
), g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings SEMI JOIN ok USING (vec_id) WHERE label IS NOT NULL
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS c FROM r GROUP BY id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e JOIN c ON c.id = e.vec_id
"""
