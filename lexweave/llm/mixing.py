"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Every source gets a target in words.  A document of a source may be copied
target / source size times, a real number of 0 to 3: its whole part is certain,
the rest is a probability that pivotal rounding turns into 0 or 1.  Two
documents with probabilities p, q and sizes m, n meet; mass moves from one to
the other, so that p*m + q*n stays the same, until one of them is integral; which
way it moves is drawn so that both probabilities are kept in expectation.  The
other one goes on with what is left.  Only the very last document of a source
is rounded alone, by a draw that keeps its probability, so a source's words miss its
target by less than that one document.

The meetings form a reduction tree.  Documents fall into chunks of about
``CHUNK`` by a hash; a chunk is folded to its one residual; the residuals of
``CHUNK`` neighbouring chunks make a chunk of the next level.  So a source with
a third of all rows is spread over as many tasks as any other rows.  The
number of levels is the logarithm of the chunks of the largest source.

All draws come from hashes of the key and a seed, so reruns agree.

A null text has size 0; rows of size 0 are taken 0 times.  The null source is a
source of its own, last.  Rows with equal id, source and text are drawn together,
as one document of their joint size, so each is copied equally often.  Empty
tables give empty results.  Only id, source and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Documents of a chunk of the reduction tree, on average.
CHUNK = 32
#: Chunks that a task folds at least: a level of few chunks is written in few files.
TASK_CHUNKS = 128
MOST_COPIES = 3
CYCLE = 3


def targets(sizes: DataFrame, most: int = MOST_COPIES, cycle: int = CYCLE) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row per source.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating.  Targets
    share the total by weight and stop at ``most`` times the source's size; the
    excess is shared again by weight.  That is one level L with
    target = min(weight * L, cap): L is where the sources are exhausted in order
    of cap / weight.  The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.select("source", "source_size", ((F.row_number().over(order) - 1) % cycle + 1).alias("weight"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the level rises while full sources are set aside and falls once others are: its peak is L
    s = s.withColumn("cut", F.max("level").over(every))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("cut")).alias("target"))


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") / F.lit(float(1 << 53))


def fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (k1, k2, m, p): decided (k1, k2, up) and the residual.

    An item of p = 0 or 1 is decided at once, as it can't take or give mass.
    """

    def meet(acc: Column, x: Column) -> Column:
        m, p, n, q = acc["m"], acc["p"], x["m"], x["p"]
        give = F.least(p * m, (1 - q) * n)  # words that can move from the residual to x
        take = F.least(q * n, (1 - p) * m)
        chance = take / (give + take)
        gives = draw(seed, acc["k1"], acc["k2"], x["k1"], x["k2"]) < chance
        moved = F.when(gives, -give).otherwise(take)
        a, b = p + moved / m, q - moved / n
        # whichever side was exhausted is integral; the comparison decides it without rounding errors
        a_done = F.when(gives, p * m <= (1 - q) * n).otherwise((1 - p) * m <= q * n)
        a_up, b_up = ~gives, gives
        gone = F.when(a_done, F.struct(acc["k1"].alias("k1"), acc["k2"].alias("k2"), a_up.alias("up"))).otherwise(F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), b_up.alias("up")))
        stays = F.when(a_done, F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), n.alias("m"), b.alias("p"))).otherwise(F.struct(acc["k1"].alias("k1"), acc["k2"].alias("k2"), m.alias("m"), a.alias("p")))
        return state(stays, F.concat(acc["done"], F.array(gone)))

    def state(rest: Column, done: Column) -> Column:
        return F.struct(*[rest[c].alias(c) for c in ("k1", "k2", "m", "p")], done.alias("done"))

    empty = F.array().cast("array<struct<k1:bigint,k2:bigint,up:boolean>>")
    first = state(items[0], empty)
    return F.aggregate(F.slice(items, 2, F.size(items)), first, meet)


def round_copies(items: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``(k1, k2, up)`` for items ``(source, k1, k2, m double, p double)`` with m > 0 and 0 < p < 1."""
    items = cut(items)
    counts = items.groupBy("source").agg(F.count("*").alias("n"))
    n_max, open_chunks, sources = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n") / chunk)), F.lit(0)), F.count("*")).first()
    chunks = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / chunk).alias("chunks"))
    level = items.join(chunks, F.col("source").eqNullSafe(F.col("s"))).select("source", "k1", "k2", "m", "p", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), "chunks").alias("at"))
    decided = None
    width, step = -(-n_max // chunk), 0
    while True:
        group = level.groupBy("source", "at").agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "m", "p"))).alias("items"))
        group = group.coalesce(max(1, -(-(open_chunks + sources) // TASK_CHUNKS)))
        folded = cut(group.select("source", "at", fold(F.col("items"), seed + step).alias("f")))
        gone = folded.select(F.explode("f.done").alias("d")).select("d.*")
        decided = gone if decided is None else decided.unionByName(gone)
        level = folded.select("source", "f.k1", "f.k2", "f.m", "f.p", F.floor(F.col("at") / chunk).alias("at"))
        if width <= 1:
            break
        width, open_chunks, step = -(-width // chunk), open_chunks // chunk, step + 1
    last = level.select("k1", "k2", (draw(seed + step + 1, F.col("k1"), F.col("k2")) < F.col("p")).alias("up"))
    return decided.unionByName(last)


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, source, k1, k2 (hash of id, source and text), size, source_size, target, copies."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = (F.col(id_col), F.col(source_col), F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(1), *key).alias("k1"), F.xxhash64(F.lit(2), *key).alias("k2"), words.alias("size"))
    rows = cut(rows)
    aims = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("part", F.greatest(ratio - F.col("whole"), F.lit(0.0))).withColumn("part", F.when(F.col("part") < 1e-12, 0.0).otherwise(F.col("part")))
    aims = aims.withColumnRenamed("source", "s")
    docs = rows.where("size > 0").groupBy("source", "k1", "k2").agg(F.sum("size").cast("double").alias("m"))
    items = docs.join(aims.where("part > 0").select("s", "part"), F.col("source").eqNullSafe(F.col("s"))).select("source", "k1", "k2", "m", F.col("part").alias("p"))
    up = round_copies(items, seed, chunk).where("up").select("k1", "k2", "up")
    out = rows.join(aims, F.col("source").eqNullSafe(F.col("s"))).join(up, ["k1", "k2"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("up"), 1).otherwise(0)).otherwise(F.lit(0))
    return out.select("id", "source", "k1", "k2", "size", "source_size", "target", copies.cast("long").alias("copies"))


def resample(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken; the columns of ``df``."""
    names = df.columns
    key = (F.col(id_col), F.col(source_col), F.col(text_col))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(F.lit(1), *key).alias("k1"), F.xxhash64(F.lit(2), *key).alias("k2"))
    taken = mix(df, id_col, source_col, text_col, seed).select("k1", "k2", "copies").distinct().where("copies > 0")
    out = rows.join(taken, ["k1", "k2"])
    return out.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"row.`{c}`") for c in names])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
