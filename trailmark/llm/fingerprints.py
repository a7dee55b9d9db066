"""Document fingerprints: a canonical exact digest; DataFrame and SQL functions only.

Canonical form: Unicode normalisation (NFKC), full case folding, NFKC again, and every run of white space as one space,
without any at the ends. The normaliser and the case folding are static methods of the Unicode library that ships with Spark, called
by the SQL function ``reflect``. A bucket is a pair of 64-bit xxhashes (128 bits). Inside equal buckets the canonical bytes
are compared: rows are grouped by hashes and canonical form together, which also combines copies before the shuffle. Should
two different forms share a bucket, all but the first in byte order get a numbered suffix.

Likeness of two exact digests is 1.0 if the canonical bytes are equal, else 0.0; an edited form that shares a bucket with its own text, but not
its bytes, gets a suffix, too.

Neighbours in descending order of doc_id (null last, then by hash of the text) come from windows over stretches of that order. The
stretches are cut by number of rows, whatever the ids are: a range partitioning of the keys alone gives each stretch's first key
(at most ``STRETCHES`` of them, which come to the driver), and every row finds its stretch by a binary search among these. Each
stretch also gets a copy of the first document of the next one, so no window spans more than one stretch and texts move once.

Null text: the empty text. Ids may be any 64-bit integers or null. Repeated rows follow one another (rows with one id and one text share a stretch); a single
document is its own next one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Documents in a stretch of the order, about, and the largest number of stretches.
STRETCH, STRETCHES = 2000, 20_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def canonical(text: Column) -> Column:
    def compose(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"[\s\p{Z}]+", " "))


def _hashes(form: str, prefix: str = "__h") -> dict[str, Column]:
    return {f"{prefix}1": F.xxhash64(F.lit("a"), F.col(form)), f"{prefix}2": F.xxhash64(F.lit("b"), F.col(form))}


def _name(prefix: str = "__h", variant: Column | None = None) -> Column:
    base = F.lower(F.concat(*[F.lpad(F.hex(f"{prefix}{i}"), 16, "0") for i in (1, 2)]))
    return base if variant is None else F.when(variant.isNull(), base).otherwise(F.concat(base, F.lit("-"), variant.cast("string")))


def shared_buckets(forms: DataFrame, buckets: tuple[str, str] = ("__h1", "__h2")) -> DataFrame:
    """Byte comparison inside equal buckets: (the buckets, __form, __variant) of every form but the first of its bucket.

    ``forms``: the bucket columns and __form. Only buckets that hold two different forms are ranked: hardly ever one.
    """
    distinct = forms.select(*buckets, "__form").distinct()
    shared = stored(distinct.groupBy(*buckets).count().where("count > 1").drop("count"))
    if shared.isEmpty():
        return shared.select(*buckets, F.lit("").alias("__form"), F.lit(1).alias("__variant")).limit(0)
    rank = F.row_number().over(Window.partitionBy(*buckets).orderBy("__form")) - 1
    return stored(distinct.join(shared, list(buckets), "left_semi").withColumn("__variant", rank).where("__variant > 0"))


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the column ``fingerprint`` (in place of one that they have)."""
    kept = [c for c in docs.columns if c != "fingerprint"]
    forms = docs.withColumn("__form", canonical(F.col(text))).withColumns(_hashes("__form"))
    variants = shared_buckets(forms)
    if variants.isEmpty():
        return forms.select(*kept, _name().alias("fingerprint"))
    return forms.join(variants, ["__h1", "__h2", "__form"], "left").select(*kept, _name(variant=F.col("__variant")).alias("fingerprint"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint and group_id: the smallest doc_id of the documents with an equal fingerprint."""
    known = fingerprinted(docs.select(doc_id, text), text).select(doc_id, "fingerprint")
    return known.join(known.groupBy("fingerprint").agg(F.min(doc_id).alias("group_id")), "fingerprint").select(doc_id, "fingerprint", "group_id")


def _order_key() -> Column:
    """Text whose order of code points is that of doc_id downwards (null last), then of the text's hash."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")  # noqa: E731  of a number taken as unsigned
    down = digits(F.coalesce("doc_id", F.lit(0)).cast("long").bitwiseXOR(F.lit(HIGH)))
    return F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), down, digits(F.xxhash64("text").bitwiseXOR(F.lit(LOW))))


def _stretch_of(key: str, firsts: list[str]) -> Column:
    """The last of the sorted ``firsts`` that isn't above the key: a binary search, one bit of the answer at a time."""
    listed = F.split(F.lit(",".join(firsts)), ",")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(firsts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step) <= F.col(key), at + step).otherwise(at))


def with_next(docs: DataFrame, stretch: int = STRETCH, also: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id and text, not null) with __next: the text of the next document in descending order of doc_id.

    ``also``: other columns of which the next document's value comes along, with ``_next`` after the name.
    """
    keyed = docs.withColumn("__key", _order_key())
    keys = stored(keyed.select("__key"))
    n = max(1, min(keys.count() // stretch, STRETCHES))
    found = keys.repartitionByRange(n, "__key").groupBy(F.spark_partition_id()).agg(F.min("__key")).collect()
    number = _stretch_of("__key", sorted(r[1] for r in found) or [""])
    rows = keyed.withColumn("__stretch", number)
    firsts = stored(keys.withColumn("__stretch", number).groupBy("__stretch").agg(F.min("__key").alias("__first")))  # one row a stretch
    order = Window.orderBy("__stretch")
    top = F.first("__stretch").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.withColumn("__after", F.coalesce(F.lead("__stretch").over(order), top)).select(F.col("__stretch").alias("__s"), "__after")
    heads = keyed.join(F.broadcast(firsts), F.col("__key") == F.col("__first")).dropDuplicates(["__stretch"])  # repeated rows
    ends = heads.join(F.broadcast(after), F.col("__stretch") == F.col("__after")).drop("__stretch", "__first", "__after").withColumnRenamed("__s", "__stretch")
    every = rows.withColumn("__end", F.lit(False)).unionByName(ends.withColumn("__end", F.lit(True)))
    window = Window.partitionBy("__stretch").orderBy("__end", "__key")
    every = every.withColumn("__next", F.lead("text").over(window)).withColumns({f"{c}_next": F.lead(c).over(window) for c in also})
    return every.where(~F.col("__end")).drop("__stretch", "__key", "__end")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("__form", canonical(F.col("text"))).withColumns(_hashes("__form"))
    variants = shared_buckets(hashed)
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - __third)"), F.expr("left(__next, __third)"))
    out = (
        with_next(hashed.drop("__form"), also=("__h1", "__h2")).withColumn("n_chars", F.length("text").cast("long")).withColumn("__third", third)
        .withColumn("__edited", edited).withColumn("edited_sha256", F.sha2("__edited", 256))
        .withColumn("__edited_form", canonical(F.col("__edited"))).withColumns(_hashes("__edited_form", "__e"))
    )
    same = lambda h: (F.col("__h1") == F.col(h.format(1))) & (F.col("__h2") == F.col(h.format(2)))
    bucket = {"__edited": same("__e{}"), "__next": same("__h{}_next")}
    # the bytes decide, and are made again only where the buckets are equal
    equal = {c: same_bucket & (canonical(F.col("text")) == (F.col("__edited_form") if c == "__edited" else canonical(F.col(c)))) for c, same_bucket in bucket.items()}
    out = out.withColumns({"near_edited": equal["__edited"].cast("double"), "near_next": equal["__next"].cast("double")})
    if variants.isEmpty():
        names = {"fingerprint": _name(), "edited_fingerprint": _name("__e")}
    else:
        for prefix, form in (("__h", "__form"), ("__e", "__edited_form")):
            known = variants.withColumnsRenamed({"__h1": f"{prefix}1", "__h2": f"{prefix}2", "__form": form, "__variant": f"{prefix}_variant"})
            out = (out.withColumn(form, canonical(F.col("text"))) if prefix == "__h" else out).join(known, [f"{prefix}1", f"{prefix}2", form], "left")
        names = {"fingerprint": _name(variant=F.col("__h_variant")), "edited_fingerprint": _name("__e", F.col("__e_variant"))}
    out = out.withColumns(names)
    told = F.when((F.col("near_edited") == 0) & (F.col("edited_fingerprint") == F.col("fingerprint")), F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", told.alias("edited_fingerprint"), "near_edited", "near_next")


def op8_exact_fingerprint(spark, sf_dir):
    return edit_likeness(table(spark, sf_dir, "documents"))
