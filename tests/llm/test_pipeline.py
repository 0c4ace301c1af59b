import duckdb
import pytest

import corpus_pipeline
from loam.llm import pii, queries, toxicity
from loam.llm.simhash import similar_documents
from tests.llm.test_text_operators import brute_lines, key
from tests.test_queries import TABLES, rows


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := stage(spark, docs, sf).cache())
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.schema.simpleString() == before.schema.simpleString(), name


def test_each_stage_does_its_operators_work(spark, sf, stages):
    before, after = stages["toxicity"]
    scores = toxicity.score_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(after) == ids(scores.filter("predicted = 0"))
    before, after = stages["line_dedup"]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=key) == [w[:2] for w in want]
    assert after.filter("n_chars <> length(text)").count() == 0
    before, after = stages["near_dedup"]
    assert ids(after) == ids(similar_documents(before).filter("doc_id = component_id"))
    before, after = stages["pii"]
    assert ids(after) == ids(before)
    assert pii.find_pii(after).filter("spans <> ''").count() == 0
    before, after = stages["packing"]
    assert ids(after) == ids(before)


def test_run_equals_the_stages(spark, sf, stages):
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf).collect())
    assert got == sorted(tuple(r)[:5] for r in stages["packing"][1].collect())


def test_other_results_outlive_a_run(spark, sf):
    """A result made before the pipeline runs, and read after it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    before = similar_documents(docs)
    want = sorted(map(tuple, before.collect()))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert sorted(map(tuple, before.collect())) == want


def test_near_copies_go_in_the_pipeline(spark, sf):
    """A text with up to three of 200 words changed (a similarity of 0.85 or more): one of its copies stays."""
    import random

    r = random.Random(1)
    words = [f"w{k}" for k in range(4000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(20)]
    rows = []
    for i, text in enumerate(base):
        rows.append((i, "\n".join(" ".join(text[k : k + 20]) for k in range(0, 200, 20)), "en", "s", 0))
        for c in range(1, 4):
            changed = r.sample(range(200), r.randint(1, 3))
            copy = [r.choice(words) if k in changed else w for k, w in enumerate(text)]
            rows.append((100 * c + i, " ".join(copy), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = ids(corpus_pipeline.drop_near_copies(spark, docs, sf))
    assert set(range(20)) <= kept and len(kept) <= 21  # of 60 copies


def test_stages_on_odd_documents(spark, sf, odd, empty):
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns
                docs = out.cache()
        n = out.count()
        assert n == 0 if start is empty else n > 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(c.execute(queries.ORACLE_SQL[name]).df())
