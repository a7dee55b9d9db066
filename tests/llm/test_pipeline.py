"""The pipeline's stages: columns, and decisions that take effect; registered queries with SQL."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == before.columns, name
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    toxic, lined, single, mixed, tokens = counts[1:]
    assert toxic < counts[0] and lined == toxic and single < lined and mixed == tokens and docs.columns[0] == "doc_id"
    assert docs.where(F.col("n_tokens") > 0).count() > 0


def test_stages_take_small_batches(spark, tmp_path):
    """Whole texts come to Python and out of Parquet in short batches; what a session has set below them stays."""
    pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    import corpus_pipeline
    from trailmark.llm.common import arrow_map

    arrow, parquet = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {key: spark.conf.get(key) for key in (arrow, parquet)}
    docs = spark.createDataFrame([], "doc_id LONG, text STRING, source STRING")
    rows = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    try:
        for _, stage in corpus_pipeline.STAGES[-2:]:
            spark.conf.unset(arrow)
            spark.conf.set(parquet, 100)
            stage(spark, docs, SF)
            sizes = [r.n for r in arrow_map(spark.range(0, 10_000, 1, 1), rows, "n bigint").collect()]
            assert sum(sizes) == 10_000 and max(sizes) <= 4096 and spark.conf.get(parquet) == "100"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_words_are_counted_without_an_array(spark):
    from trailmark.llm.common import WORD
    from trailmark.llm.mixing import size_of

    texts = [None, "", " ", "a", " a", "a ", "  x", "\U0001f600b \U0001f600", "\t\x0b\x0c\r\n a\x1fb\x85c  d", "  z\u3000y", " " * 5000 + "w", "$1 \\ $0"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = df.select(size_of().alias("n"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("want"), "text")
    assert all(r.n == r.want == len((r.text or "").encode().split()) for r in got.collect())
    assert "regexp_extract_all" not in df.select(size_of())._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [0, 40])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Nulls in every column, repeated rows, extra columns with names that the operators use, no labels, and no rows at all."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    texts = [None, "", " ", "one line\n\n", "word " * 30_000, " ".join(words), " ".join(words), " ".join(words[:59])] + [f"alone {i} " + " ".join(f"x{i}y{k}" for k in range(20)) for i in range(32)]
    data = [(None if i == 9 else i, t, None if i % 3 else "en", None if i % 5 else "s", None if i % 4 else 7, "n", 1) for i, t in enumerate(texts)][:rows]
    data += data[12:13]
    docs = spark.createDataFrame(data, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, node STRING, template LONG")
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(kept["toxicity"]) == len(kept["line dedup"]) == len(data)  # nothing is known to be toxic
    if rows:
        single = kept["n-gram Jaccard join"]
        assert {5} == {5, 6, 7} & {*single} and len(single) == len(data) - 3 and {0, 1, 2, None} <= {*single}
        assert {*kept["byte-level BPE"]} == {*kept["mixing sources to target weights"]} <= {*single}


def test_queries_have_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from trailmark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        names = sorted(df.columns)
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        want = sorted(tuple(str(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
        assert sorted(columns) == names and sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want, name


def test_numbered_queries_are_registered():
    from trailmark.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 14))


def test_thresholds_join_once_a_level(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from trailmark.llm import mixing

    slim = spark.createDataFrame([(s, n, h) for s in ("a", None) for n, h in ((3, 5), (4, 1 << 50), (0, 7))], "source STRING, size LONG, hash LONG")
    goals = spark.createDataFrame([("a", 7, 10.0), (None, 7, 4.0), ("z", 0, 0.0)], "source STRING, source_size LONG, target DOUBLE")
    joins, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda *a, **b: joins.append(1) or join(*a, **b))
    got = {r.source: (r.full, r["last"], r.also) for r in mixing.thresholds(slim, goals).collect()}
    assert got == {"a": (1, 1 << 50, False), None: (0, 1 << 50, False), "z": (0, None, None)}
    assert len(joins) == mixing.LEVELS + 1
