from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpus import SPACES, sentence
from fabtrail.llm import catalog


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(k, sentence(k, 60 + k), "en", f"s{k % 3}", 0) for k in range(40)]
    rows += [(100 + k, sentence(k, 60 + k), "en", "s0", 0) for k in range(10)]
    rows += [(200 + k, sentence(k, 60 + k) + " tail", "en", "s1", 0) for k in range(10)]
    rows += [(300 + k, "BUY!! NOW!! | " * 30 + str(k), "en", "s2", 0) for k in range(40)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 300 <= i < 400 else 1, 0) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: Counter(r.doc_id for r in frame.collect()) for name, frame in seen.items()}
    good = {i for i, *_ in rows if not 300 <= i < 400}
    assert set(ids["quality"]) - {400, 401} == good - {400, 401}
    texts = {i: SPACES.sub(" ", t or "") for i, t, *_ in rows}
    groups = defaultdict(list)
    for i in ids["quality"]:
        groups[texts[i]].append(i)
    assert ids["exact_dedup"] == Counter(min(g) for g in groups.values())
    assert set(ids["jaccard"]) == {i for i in ids["exact_dedup"] if i < 200 or i >= 300}
    assert set(ids["mixing"]) <= set(ids["jaccard"])
    packed = defaultdict(int)
    for r in seen["packing"].collect():
        packed[r.doc_id] += r.length
    assert set(packed) == set(ids["mixing"])


def test_run_of_nothing(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "jaccard", "mixing", "packing"]


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in catalog.ORACLE.items():
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        got = catalog.QUERIES[name](spark, sf).select(*names).collect()
        close = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
        assert sorted(map(close, got)) == sorted(map(close, want.fetchall()))
