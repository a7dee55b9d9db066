"""Mixing sources to target weights with nested histograms of hash thresholds; DataFrame functions only.

Sources, in order of code points with null last, weigh ``weights``, repeating, and share the words of all documents.
A target stops at ``most`` times its source's size; the excess goes to the others by weight until none is above: that is
min(level * weight, most * size) with one level for all, found from prefix sums over the sources by most * size / weight.

A source gives every document floor(target / size) times, and the documents whose hash is under a threshold once more. The
threshold comes from histograms: words by source and the first 12 bits of a 60-bit hash; running sums find the bucket in which
the budget ends; only that bucket is counted again by the next 12 bits, down to single hash values. The one at the end is taken
if that brings the sum nearer. The last step is a filter: no row is sorted, and only histograms (4096 rows a source) and
one row a source move.

Hot sources do no harm, since the sums are combined before the shuffle. The hash is taken over id and text, so reruns agree and rows
with a null id are dealt apart; rows that are equal in both are taken together. Null texts and those without words have size 0 and
are taken 0 words. An empty table gives an empty table; where all sizes are 0, so are all targets. Other columns pass by:
the operator names its own with a leading double underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

LEVELS, BITS = 5, 12
#: A word with the white space behind it (its first character is the group), or white space before the first word.
WORD_AND_GAP = r"([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+|[\x20\x09-\x0D]++"


def size_of(text: str = "text") -> Column:
    """Number of words. Each leaves its first character; ``regexp_count`` would make an array of all words of a text, which fills an executor's heap."""
    return F.coalesce(F.length(F.regexp_replace(F.col(text), WORD_AND_GAP, "$1")), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the digest of id and text."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size, target of a table of (source, source_size); its windows see one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__w", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy((cap / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    # the level if exactly the sources before this one were capped; it holds from the first that stays under its cap
    level = (F.sum("source_size").over(whole) - capped(cap)) / (F.sum("__w").over(whole) - capped("__w"))
    leveled = ranked.withColumn("__level", level).withColumn("__ratio", cap / F.col("__w"))
    holds = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct(F.col("__ratio"), F.col("source").isNull(), F.col("source"), F.col("__level").alias("level")))).over(whole)
    return leveled.withColumn("__level", holds["level"]).select(
        "source", "source_size", F.when(F.col("__ratio") < F.col("__level"), cap).otherwise(F.col("__level") * F.col("__w")).alias("target")
    )


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """source, full, last, also: a document is taken ``full`` times, once more if hash < last, or hash = last and ``also``.

    ``slim``: (source, size, hash); ``goals``: (source, source_size, target). Sources without a remainder have a null ``last``.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = goals.withColumn("full", full.cast("long")).withColumn("left", F.col("target") - F.col("full") * F.col("source_size"))
    rows = slim.where("size > 0")  # only histograms of it move
    state = goals.select("source", "left", F.lit(0).cast("long").alias("last"))
    for k in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - k)
        # one join a level: rows of the bucket in which their source's budget ends bring what is left of it along
        budget = state.select(F.col("source").alias("__s"), F.col("left").alias("__left"), F.col("last").alias("__last"))
        inside = rows.join(budget, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("hash", shift + BITS) == F.col("__last")))
        histogram = inside.groupBy("source", "__left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        over = histogram.withColumn("upto", F.sum("words").over(running)).where("upto > __left")
        # the first bucket in which the running sum passes what is left; the next levels are inside of it, so no source is lost there
        end = F.struct("bucket", "words", (F.col("__left") - (F.col("upto") - F.col("words"))).alias("left"))
        ends = over.groupBy("source").agg(F.min_by(end, "bucket").alias("end")).select("source", F.col("end.bucket").alias("last"), F.col("end.left").alias("left"), F.col("end.words").alias("at_end"))
        if k < LEVELS:
            state = stored(ends)  # a row a source, written so that the next level's plan doesn't repeat all levels before
    ends = ends.withColumnsRenamed({"source": "__s", "left": "__left"})
    return stored(goals.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "full", "last", (F.col("__left") * 2 >= F.col("at_end")).alias("also")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken and ``__times`` (how often the mix takes the document)."""
    slim = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), hash_of(doc_id, text).alias("hash")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, most))
    plan = thresholds(slim.select("source", "size", "hash"), goals)
    return _applied(slim, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source and hash) and what the plan says of each: source_size, target, times."""
    plan = plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns})
    more = (F.col("hash") < F.col("__last")) | ((F.col("hash") == F.col("__last")) & F.col("__also"))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left").select(
        *rows.columns, F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__full") + F.coalesce(more, F.lit(False)).cast("long")).alias("times"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, all columns, repeated as often as it takes them; those without words stay once."""
    slim = stored(docs.select(F.col(source).alias("source"), size_of(text).alias("size"), hash_of(doc_id, text).alias("hash")))
    goals = stored(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    plan = thresholds(slim, goals).select(F.col("source").alias("__source"), F.col("full").alias("__full"), F.col("last").alias("__last"), F.col("also").alias("__also"))
    h = hash_of(doc_id, text)
    more = F.coalesce((h < F.col("__last")) | ((h == F.col("__last")) & F.col("__also")), F.lit(False))
    times = F.when(~F.coalesce(F.col(text).rlike(WORD), F.lit(False)), F.lit(1)).otherwise(F.col("__full") + more.cast("long")).cast("int")
    joined = docs.join(plan, F.col(source).eqNullSafe(F.col("__source")), "left").withColumn("__times", times)
    return joined.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op5_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (
  SELECT *, CAST([5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)] AS DOUBLE) AS w FROM sizes),
leveled AS (
  SELECT *, source_size * CAST(3 AS DOUBLE) AS cap, source_size * CAST(3 AS DOUBLE) / w AS ratio,
         ((sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(source_size * CAST(3 AS DOUBLE)) OVER (ORDER BY source_size * CAST(3 AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY source_size * CAST(3 AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goals AS (
  SELECT source, source_size, CASE WHEN ratio < l THEN cap ELSE l * w END AS target
  FROM leveled, (SELECT arg_min(level, ratio) AS l FROM leveled WHERE level <= ratio)),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_times FROM goals),
hashes AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
  FROM docs WHERE size > 0 GROUP BY source, h),
ends AS (
  SELECT p.source, min(x.h) AS last, arg_min((p.target - p.full_times * p.source_size - (x.upto - x.words)) * 2 >= x.words, x.h) AS also
  FROM parts p JOIN hashes x ON p.source IS NOT DISTINCT FROM x.source
  WHERE x.upto > p.target - p.full_times * p.source_size GROUP BY p.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(d.size * (p.full_times + CASE WHEN d.h < e.last OR (d.h = e.last AND e.also) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source
"""
