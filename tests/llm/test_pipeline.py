import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from quillspan.llm.shared import Scratch

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), scratch.keep(stage(spark, docs, DATA))
        assert docs.columns == columns and 0 < docs.count() <= before, name
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns with names that operators use, empty tables."""
    import corpus_pipeline

    passage = " ".join(f"word{i}" for i in range(40))
    rows = [(1, passage), (2, passage + " end"), (2, passage + " end"), (None, None), (None, None), (3, None), (4, ""), (5, "  \n "), (6, "token = abcdefgh1234"), (7, "one two three"), (7, "four five six")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, `a.b` int, c0 int, key string"
    docs = spark.createDataFrame([(i, t, "en", None if i == 3 else "s", None if t is None else len(t), 1, 2, 3, "k") for i, t in rows], schema)
    spark.createDataFrame([(1, 0, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "word0 word1 word2 something else"), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"toxicity": 11, "near_copies": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "mixing" or out.columns == docs.columns, name
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.columns == out.columns and nothing.count() == 0, name
        got = out.collect()
        assert len(got) == want.get(name, 11), name
        if name == "near_copies":
            assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted({(i or 0, t or "") for i, t in rows if i != 2})
        if name == "secrets":
            assert [r.text for r in got if r.doc_id == 6] == ["[SECRET]"] and [r.n_chars for r in got if r.doc_id == 6] == [8]


@pytest.mark.parametrize("name", ["op1_decontamination", "op10_repeats"])
def test_oracle(spark, name):
    from quillspan.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert [d[0] for d in result.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())
