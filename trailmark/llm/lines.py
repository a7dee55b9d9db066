"""Line dedup by a log-template tree of fixed depth.

Each line of a text is parsed: its tokens (between ASCII white space) are counted, and tokens that vary by their shape (those with a digit or
an ``@``) become ``<*>``. The result is the line's own template. The tree puts lines that differ in named fields under common ones (``user alice
logged in``, ``user bob logged in``): its first level is the token count, and below it the tokens lead in at most ``DEPTH`` steps (a token each, or
sixths of a longer line) to a leaf, a template. At each step a line takes the branch of its own tokens, if that branch can still hold a
recurring template, and the ``<*>`` branch, for up to ``FIELDS`` steps, as long as ``FIXED_STEPS`` steps stay fixed. A branch can hold one only if
several own templates in ``MIN_DOCUMENTS`` texts pass through it, and these are counts over all lines: the tree grows level by level, for all lines
at once, and doesn't depend on their order. Lines of three tokens or fewer have their own template only.

A template recurs when ``MIN_DOCUMENTS`` documents hold it. Texts that are equal count as one document, and so do texts that share most of their
sentences, so that the lines of a much-copied document stay: these are found by ``BANDS`` hashes, each of ``BAND_ROWS`` minima over the text's set of
sentences (what stands between full stops in a line): two texts of likeness 0.8 have one in common but for 1 case in 2,900, of 0.5 in every second case, of 0.1 in 1 case of 5,000. Lines
under a recurring template, their own or one of the tree, are dropped from all documents, whatever their length, their place and the lines beside them.

Counting goes over distinct (template, text) rows, combined before each shuffle, so hot lines and large groups of copies
meet as counts only. What is dropped depends on the text alone; the lists of dropped lines therefore go back to the documents by
the text's 128-bit hash. Blank lines have no template and stay. A null text stays null and an empty one empty; a document may lose all its
lines and keeps its row. Repeated rows lose the same lines; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped
from .common import arrow_map, per_row, stored, table

DEPTH, FIELDS, FIXED_STEPS, MIN_DOCUMENTS = 6, 2, 3, 10
#: Lines of fewer tokens that all vary by shape stand for themselves ("7", "10:30").
SHORT = 4
BANDS, BAND_ROWS = 20, 5
_MIX = np.random.default_rng(11).integers(1 << 62, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Own templates that a task remembers.
SEEN = 300_000
SHAPE, VARIES = re.compile(rb"[0-9@]"), re.compile(rb"(?<![^\x20])[^\x200-9@]*+[0-9@][^\x20]*+")


def parsed(line: bytes, known: set[int] | tuple = ()) -> tuple[int | None, bytes, list[int | None]]:
    """Key of a line's own template (None: a blank line), its text with ``<*>`` for what varies by shape, and its steps in the
    tree (None: nothing in it is fixed), which are empty if too few are fixed or the template is ``known``."""
    tokens = line.split()
    n = len(tokens)
    if not n:
        return None, b"", []
    text = b" ".join(tokens)
    plain = True
    if SHAPE.search(text):
        general = VARIES.sub(b"<*>", text)
        if n >= SHORT or general.count(b"<*>") < n:
            text, plain = general, False
    key = _signed(text, n)
    if n <= FIXED_STEPS or key in known:
        return key, text, []
    if not plain:
        tokens = text.split(b" ")
    depth = min(n, DEPTH)
    ends = [i * n // depth for i in range(depth + 1)]
    steps = [tokens[a:b] for a, b in zip(ends, ends[1:])]
    keys = [None if not plain and x.count(b"<*>") == len(x) else _signed(b" ".join(x)) for x in steps]
    return key, text, keys if depth - keys.count(None) >= FIXED_STEPS else []


def _signed(text: bytes, seed: int = 0) -> int:
    h = xxhash.xxh3_64_intdigest(text, seed)
    return h - (1 << 64) if h >> 63 else h


def bands(keys: set[int]) -> list[int]:
    """``BANDS`` hashes of a set of sentences: two sets have each in common with probability likeness ** ``BAND_ROWS``."""
    found = np.fromiter(keys, np.int64, len(keys)).view(np.uint64)
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096] * _MIX).min(1))
    raw, width = least.tobytes(), 8 * BAND_ROWS
    return [xxhash.xxh3_64_intdigest(raw[b * width : (b + 1) * width], b) >> 1 for b in range(BANDS)]


_STEPS = [f"s{i}" for i in range(DEPTH)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text hashes, text) -> a row for each line that isn't blank, and one for each band of the text, at a negative line.

    The steps of an own template come with the first line that has it (and again after ``SEEN`` others)."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("template", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), *((c, pa.int64()) for c in _STEPS)])
    seen: set[tuple[int, int]] = set()  # hashes of this task's texts: copies are parsed once
    known: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            t1s, t2s, counts, keys, where = [], [], [], [], []
            rows, paths = [], []  # which rows have steps, and (number of tokens, steps) of each
            for t1, t2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                own, began = set(), len(keys)
                for i, line in enumerate(text.as_py().encode().split(b"\n")):
                    key, normal, steps = parsed(line, known)
                    if key is None:
                        continue
                    own.update(map(_signed, normal.split(b". ")))
                    keys.append(key)
                    where.append(i)
                    if steps:
                        if len(known) >= SEEN:
                            known.clear()
                        known.add(key)
                        rows.append(len(keys) - 1)
                        paths.append((normal.count(b" ") + 1, *steps, *(None,) * (DEPTH - len(steps))))
                if own:
                    keys += bands(own)
                    where += range(-1, -1 - BANDS, -1)
                    t1s.append(t1)
                    t2s.append(t2)
                    counts.append(len(keys) - began)
            if keys:
                texts = [pa.array(np.repeat(np.array(t, np.int64), counts)) for t in (t1s, t2s)]
                at_row = np.full(len(keys), -1)
                at_row[rows] = np.arange(len(rows))
                index = pa.array(at_row, mask=at_row < 0)
                steps = [pa.array(c, f.type).take(index) for c, f in zip(zip(*paths) if paths else [()] * (DEPTH + 1), list(schema)[4:])]
                yield pa.RecordBatch.from_arrays([*texts, pa.array(keys, pa.int64()), pa.array(where, pa.int32()), *steps], schema=schema)


def _text_hashes(text: str) -> list:
    return [F.xxhash64(F.lit("a"), F.col(text)).alias("t1"), F.xxhash64(F.lit("b"), F.col(text)).alias("t2")]


def parsed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """t1, t2 (the text's hash), template, line of every line that isn't blank, with the steps of some; bands at negative lines. Copies may repeat."""
    rows = docs.where(F.length(text) > 0).select(*_text_hashes(text), F.col(text).alias("text"))
    return arrow_map(rows, _parsed, ", ".join(["t1 bigint, t2 bigint, template bigint, line int, n int", *(f"{c} bigint" for c in _STEPS)]))


def families(sketches: DataFrame) -> DataFrame:
    """t1, t2, family: texts that share most of their sentences have one family; a text that shares no band has no row.

    ``sketches``: t1, t2, band. A band takes the most common band of any text that has it, and a text the most common of its
    bands' bands, so that copies that lost the group's most common band to an edit join by another one.
    """
    rows = sketches.distinct()
    shared = stored(rows.join(rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"))
    top = shared.groupBy("t1", "t2").agg(F.max(F.struct("n", "band")).alias("top"))
    label = shared.join(top, ["t1", "t2"]).groupBy("band").agg(F.max("top").alias("label"))
    return shared.join(label, "band").groupBy("t1", "t2").agg(F.max("label")["band"].alias("family"))


def may_share_leaves(own: DataFrame, whole) -> DataFrame:
    """``own`` without templates that can't share a recurring leaf: fields in two of six steps leave one of three pairs of steps as it is."""
    pair = lambda i: F.when(F.col(_STEPS[i]).isNotNull() & F.col(_STEPS[i + 1]).isNotNull(), F.xxhash64("n", F.lit(i), _STEPS[i], _STEPS[i + 1]))
    pairs = F.explode(F.filter(F.array(*map(pair, range(0, DEPTH, 2))), lambda x: x.isNotNull()))
    keys = own.where(F.col("n") >= DEPTH).select("template", "texts", pairs.alias("pair"))
    shared = keys.groupBy("pair").agg(whole.alias("open")).where("open").select("pair")
    near = keys.join(shared, "pair", "left_semi").select("template").distinct()
    full = (F.col("n") >= DEPTH) & (sum(F.col(c).isNull().cast("int") for c in _STEPS) == 0)  # others have fewer steps, or some that are fields already
    return own.where(full).join(near, "template", "left_semi").unionByName(own.where(F.col("n").isNotNull() & ~full))


def tree(own: DataFrame, least: int) -> DataFrame:
    """template, leaf: the leaves that own templates reach, of those that several of them in ``least`` texts reach together.

    ``own``: template, texts (how many hold it), n, s0 to s5 (its steps). One level of the tree at a time; a hot branch is
    counted before it is shuffled, and its rows, one for each own template, may be split in the join.
    """
    whole = (F.sum("texts") >= least) & (F.count("*") > 1)  # sums of texts are bounds from above on documents
    fixed = sum(F.col(c).isNotNull().cast("int") for c in _STEPS)
    rows = stored(may_share_leaves(own, whole).withColumns({"node": F.col("n").cast("long"), "fields": F.least(fixed - FIXED_STEPS, F.lit(FIELDS))}))
    for i, step in enumerate(_STEPS):
        open_ = rows.where(F.col(step).isNotNull()).groupBy("node", step).agg(whole.alias("open")).where("open")
        to = lambda node, fields: F.struct(node.alias("node"), fields.alias("fields"))
        field, left = F.xxhash64("node", F.lit("<*>")), F.col("fields")
        children = (
            F.when(F.col("n") <= i, F.array(to(F.col("node"), left)))
            .when(F.col(step).isNull(), F.array(to(field, left)))
            .otherwise(F.array(F.when(F.col("open"), to(F.xxhash64("node", step), left)), F.when(left > 0, to(field, left - 1))))
        )
        grown = rows.join(open_, ["node", step], "left").withColumn("child", F.explode(F.filter(children, lambda x: x.isNotNull())))
        below, rows = rows, stored(grown.select("template", "texts", "n", *_STEPS[i + 1 :], "child.*"))
        dropped(below)
    leaves = rows.groupBy("node").agg(whole.alias("open")).where("open").select("node")
    found = stored(rows.join(leaves, "node", "left_semi").select("template", F.col("node").alias("leaf")))
    dropped(rows)
    return found


def recurring(parsed: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """template of the own templates that ``min_documents`` documents hold or that lie under such a leaf; copies, equal or nearly so, are one document."""
    lines = parsed.where("line >= 0")
    own = stored(lines.groupBy("template").agg(F.count_distinct("t1").alias("texts"), *(F.max(c).alias(c) for c in ("n", *_STEPS))))
    leaves = tree(own, min_documents)
    held = own.where(F.col("texts") >= min_documents)  # in as many texts; their families can only be fewer
    under = stored(held.select("template", F.col("template").alias("leaf")).unionByName(leaves))
    each = lines.select("template", "t1", "t2").join(under, "template").select("leaf", "t1", "t2").distinct()
    kin = stored(families(parsed.where("line < 0").select("t1", "t2", F.col("template").alias("band"))))
    each = each.join(kin, ["t1", "t2"], "left").select("leaf", F.coalesce("family", "t1").alias("family")).distinct()
    often = each.groupBy("leaf").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)
    found = stored(under.join(often, "leaf", "left_semi").select("template").distinct())
    dropped(own, leaves, under, kin)
    return found


def _cut(row: dict) -> tuple:
    """(text without the dropped lines, lines, dropped)."""
    text, drop = row["text"], row["drop"]
    if not drop:
        return text, 0 if text is None else text.count("\n") + 1, 0
    gone, rows = set(drop), text.split("\n")
    return "\n".join([x for i, x in enumerate(rows) if i not in gone]), len(rows), len(gone)


def without_recurring(docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and the columns __lines and __dropped (counts)."""
    parsed = stored(parsed_lines(docs, text))  # texts are parsed once, for the counts and for what they drop
    drop = recurring(parsed, min_documents)
    hit = parsed.where("line >= 0").join(drop, "template", "left_semi").groupBy("t1", "t2").agg(F.collect_set("line").alias("__drop"))  # bounded by one text's lines
    hit = stored(hit)  # so that a large group of copies, which meets in one partition of the join, can be split there
    dropped(parsed, drop)
    t1, t2 = _text_hashes(text)
    rows = docs.withColumns({"__t1": t1, "__t2": t2}).join(hit.withColumnsRenamed({"t1": "__t1", "t2": "__t2"}), ["__t1", "__t2"], "left")
    others = [c for c in docs.columns if c != text]
    both = rows.select(*others, F.struct(F.col(text).alias("text"), F.col("__drop").alias("drop")).alias("__both"))
    fields = [("__kept", pa.string(), "string"), ("__lines", pa.int64(), "bigint"), ("__dropped", pa.int64(), "bigint")]
    return per_row(both, "__both", _cut, fields, others).withColumnRenamed("__kept", text).select(*docs.columns, "__lines", "__dropped")


def lines_removed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without their recurring lines; n_chars follows the text."""
    out = without_recurring(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op10_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_recurring(docs).select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
