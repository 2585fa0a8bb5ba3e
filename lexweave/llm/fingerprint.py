"""Document fingerprints by winnowing; DataFrame functions only.

Tokens are told by the text around them alone, never by the distance from its start: a
word (run without ASCII white space) of up to ``TOKEN`` characters is one; a longer run
is cut after each of a fixed set of common characters; characters of scripts without
spaces are tokens of their own.  A text of fewer than ``SHORT`` tokens is taken
character by character.  So an edit changes the tokens next to it and no others.

The hash of the k tokens at a place is a polynomial modulo a prime, as of a rolling hash:
``h[i + 1] = B * (h[i] - t[i] * B**(k - 1)) + t[i + k]``; all places are computed side by side by
doubling, as ``h2k[i] = hk[i] * B**k + hk[i + k]``.  In every window of w hashes the least
one is chosen, the rightmost of equal ones; a choice is one long: 31 bits of hash
above 32 bits that fall with the position, so the plain minimum is that rule.
Window minima also come by doubling, so a text costs n * (log k + log w).
Positions are kept; two texts that share w + k - 1 tokens in a row share a
fingerprint.

Null texts count as empty: no fingerprint, an empty string.  A text of fewer
than k tokens has one gram, one of fewer than w grams one window.  Two texts
without fingerprints are alike (1), one without and one with are not (0).
Ids may be of any type that has an order.  Repeated ids, and null ids, which come last,
follow each other by a hash of the text; equal rows follow each other.  A single row is
followed by itself.  Empty tables give empty results.  Only the id and text
columns are read, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

TOKEN, GRAM, WINDOW = 16, 4, 4
#: Texts of fewer tokens are cut into characters.
SHORT = 8
#: Characters of Thai, Lao, Tibetan, Myanmar, Khmer, Han, Kana and their kin.
ALONE = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
SPACE = r"\x20\x09-\x0D"
#: Where longer runs are cut.
ENDS = r"aeinrt0369/_.\-"
RUN = rf"[^{SPACE}{ALONE}]"
TOKENS = rf"{RUN}{{1,{TOKEN}}}+(?!{RUN})|[{ALONE}]|{RUN}{{0,{TOKEN - 1}}}?[{ENDS}]|{RUN}{{1,{TOKEN}}}"
#: The rolling hash's base and prime; a product of two residues fits into a long.
BASE, PRIME = 1_103_515_245, (1 << 31) - 1
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS = 4


def shifted(a: str, by: int) -> Column:
    """The array without its first ``by`` entries."""
    return F.slice(a, by + 1, F.size(a))


def tokens(text: Column) -> Column:
    """Tokens of a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    return F.when(F.size(words) < SHORT, F.regexp_extract_all(text, F.lit(f"[^{SPACE}]"), F.lit(0))).otherwise(words)


def choices(df: DataFrame, text_col: str, out: str, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Adds ``out``, the distinct choices of the text by position; k and w are powers of two."""
    g, m = f"{out}_g", f"{out}_m"
    df = df.withColumn(g, tokens(F.coalesce(F.col(text_col), F.lit("")))).withColumn(g, F.transform(g, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))))
    df = df.withColumn(f"{out}_n", F.size(g))
    step = 1
    while step < k:
        # past the end the second half is 0: a short text's only gram
        power = pow(BASE, step, PRIME)
        df = df.withColumn(g, F.zip_with(g, shifted(g, step), lambda x, y: (x * power + F.coalesce(y, F.lit(0))) % PRIME))
        step *= 2
    full = F.greatest(F.col(f"{out}_n") - (k - 1), F.least(F.col(f"{out}_n"), F.lit(1)))
    rank = F.lit((1 << 32) - 1)
    df = df.withColumn(m, F.transform(F.slice(g, 1, full), lambda h, i: F.shiftleft(h, 32) + (rank - i)))
    step = 1
    while step < w:
        df = df.withColumn(m, F.zip_with(m, shifted(m, step), lambda x, y: F.least(x, y)))
        step *= 2
    windows = F.greatest(F.size(m) - (w - 1), F.least(F.size(m), F.lit(1)))
    return df.withColumn(out, F.array_distinct(F.slice(m, 1, windows))).drop(g, m, f"{out}_n")


def hashes(choice: Column) -> Column:
    return F.array_distinct(F.transform(choice, lambda x: F.shiftright(x, 32)))


def written(choice: Column) -> Column:
    """``hash@position`` of each choice, joined by commas."""
    return F.array_join(F.transform(choice, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), (F.lit((1 << 32) - 1) - x.bitwiseAND((1 << 32) - 1)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of the joint hashes that both have; of two sets of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    joint = F.size(a) + F.size(b) - both
    return F.when(joint == 0, F.lit(1.0)).otherwise(both / joint)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and ``choices array<long>`` of every row."""
    return choices(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "choices")


def bucket_of(heads: Column, key: Column, buckets: int) -> Column:
    """Place of the last of the falling ``heads`` that is not below the key, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        above = F.get(heads, middle) >= key
        return F.struct(F.when(above, middle).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.size(heads).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, buckets.bit_length()))), start, halve)["low"]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprints`` with the next row by falling id (after the last the first) as ``next``.

    Ids alone are range partitioned; the first key of each part is the head of a bucket of
    neighbouring ids.  Heads are one row, a key for each bucket and never more, which every task gets;
    a row finds its bucket by halving.  Texts are dealt by bucket, once, and each bucket gets a copy of
    the following one's first row, so no task sees the whole order.
    """
    spark = df.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).alias("key"), text.alias("text"))
    dealt = rows.select("key").repartitionByRange(n, F.col("key").desc()).select("key", F.spark_partition_id().alias("part"))
    heads = cut(dealt.groupBy("part").agg(F.max("key").alias("key")))
    heads = cut(heads.agg(F.sort_array(F.collect_list("key"), asc=False).alias("heads")))
    every = rows.join(F.broadcast(heads)).select("key", "text", bucket_of(F.col("heads"), F.col("key"), n).alias("bucket"), F.lit(0).alias("extra"))
    follow = heads.select(F.posexplode("heads").alias("i", "key"), F.size("heads").alias("of")).select("key", F.pmod(F.col("i") + F.col("of") - 1, F.col("of")).alias("bucket"))
    # a bucket's head is one text, whatever rows repeat it
    first = rows.join(F.broadcast(follow), "key").groupBy("key", "bucket").agg(F.max("text").alias("text")).select("key", "text", "bucket", F.lit(1).alias("extra"))
    # only texts are dealt; fingerprints are made where a bucket's rows have come together
    made = choices(every.unionByName(first).repartition("bucket"), "text", "choices")
    w = Window.partitionBy("bucket").orderBy("extra", F.col("key").desc())
    return made.withColumn("next", F.lead(F.struct("text", "choices")).over(w)).where("extra = 0").select("key.id", "text", "choices", "next")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    df = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut)))
    df = choices(df, "edited", "edited_choices")
    df = df.withColumn("own", hashes(F.col("choices")))
    return df.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("choices")).alias("fingerprint"),
        written(F.col("edited_choices")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_choices"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next.choices"))).alias("near_next"),
    )
