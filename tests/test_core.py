import json
import struct

import pytest
from pyspark.sql import functions as F

from quillspan import functions as fn
from quillspan import output
from quillspan.catalog import Catalog
from quillspan.errors import QueryError
from quillspan.operators import changelog, domain, files, graph, table_api, tree
from quillspan.sources import dbd, payload
from quillspan.sources.listfile import parse_lines
from quillspan.sql import collected, explain, inferred, parameter_names, run_sql, stream


@pytest.fixture(scope="module")
def catalog(spark):
    effects = spark.createDataFrame([(1, 100, 0, 10), (2, 100, 1, 20), (3, 200, 0, None), (4, 300, 0, 5)], "ID long, SpellID long, EffectIndex long, BasePoints int")
    names = spark.createDataFrame([(100, "Fire"), (200, "Ice")], "ID long, Name_lang string")
    return Catalog(spark).add("SpellEffect", effects, {"ID": "id", "SpellID": "relation"}).add("SpellName", names, {"ID": "id"})


def ids(df):
    return [r["ID"] for r in df.collect()]


def test_sql(spark, catalog):
    assert ids(run_sql(spark, "SELECT ID, BasePoints FROM SpellEffect WHERE ID IN (1,2) ORDER BY ID DESC")) == [2, 1]
    assert ids(run_sql(spark, "SELECT ID FROM static.SpellName WHERE LOWER(Name_lang) LIKE '%ir%' LIMIT 1")) == [100]
    assert len(run_sql(spark, "SELECT * FROM SpellEffect WHERE SpellID = :spell_id", {"spell_id": 100}).collect()) == 2
    got = run_sql(spark, "SELECT e.SpellID, COUNT(*) AS n FROM SpellEffect e LEFT JOIN SpellName s ON e.SpellID = s.ID WHERE e.BasePoints IS NOT NULL GROUP BY e.SpellID HAVING COUNT(*) >= 1")
    assert {tuple(r) for r in got.collect()} == {(100, 2), (300, 1)}
    assert ids(run_sql(spark, "SELECT ID FROM SpellEffect ORDER BY EffectIndex ASC, ID DESC LIMIT 2 OFFSET 1")) == [3, 1]
    assert sorted(ids(run_sql(spark, "SELECT ID FROM SpellEffect WHERE SpellID IN (SELECT ID FROM SpellName WHERE Name_lang NOT LIKE 'I%')"))) == [1, 2]
    assert [r.ID for r in stream(run_sql(spark, "SELECT ID FROM SpellEffect WHERE BasePoints IS NOT NULL ORDER BY ID"), 2)] == [1, 2]
    assert any("Scan" in r.line for r in explain(spark, "SELECT ID FROM SpellEffect WHERE ID = 1").collect())


@pytest.mark.parametrize(
    ("text", "params", "code"),
    [
        ("SELECT ID FROM SpellEffect WHERE SpellID = :a", {}, "sql_missing_parameter"),
        ("SELECT ID FROM SpellEffect", {"a": 1}, "sql_unknown_parameter"),
        ("SELECT ID FROM Nope", {}, "sql_unknown_table"),
        ("SELECT Nope FROM SpellEffect", {}, "sql_unknown_column"),
        ("SELECT ID FROM SpellEffect e JOIN SpellName n ON e.SpellID = n.ID", {}, "sql_ambiguous_column"),
        ("SELECT ID FROM effective.SpellEffect", {}, "sql_unknown_catalog"),
        ("SELEC ID", {}, "sql_parse_error"),
        ("SELECT ID FROM SpellEffect WHERE ID + 1", {}, "sql_type_mismatch"),
        ("DROP TABLE SpellEffect", {}, "sql_unsupported_feature"),
    ],
)
def test_error_codes(spark, catalog, text, params, code):
    with pytest.raises(QueryError) as e:
        run_sql(spark, text, params)
    assert e.value.code == code


def test_recursion_limit(spark):
    df = run_sql(spark, "WITH RECURSIVE t(n) MAX RECURSION LEVEL 10 AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT * FROM t")
    with pytest.raises(QueryError) as e:
        collected(df)
    assert e.value.code == "sql_recursive_limit"


def test_parameters():
    assert parameter_names("SELECT ':x', :a -- :b\n, c::int") == {"a"}
    assert [inferred(x) for x in ("null", "true", "1", "12", "1.5", "'a'", "b")] == [None, True, True, 12, 1.5, "a", "b"]


def test_functions(spark):
    df = spark.createDataFrame([("3.0", 3.0, 0.0, "a_b"), ("x", -7.5, 2.0, "acb"), (None, None, None, None)], "s string, x double, y double, t string")
    got = df.select(fn.lenient_cast(F.col("s"), "DOUBLE").alias("d"), fn.lenient_cast(F.col("x"), "INT").alias("i"), fn.lenient_cast(F.col("x"), "TEXT").alias("t"), fn.lenient_cast(F.col("x"), "nope").alias("n"), fn.divide(F.col("x"), F.col("y")).alias("q"), fn.modulo(F.col("x"), F.col("y")).alias("m"), fn.like_percent(F.col("t"), "a_b").alias("l")).collect()
    assert tuple(got[0]) == (3.0, 3, "3", None, None, None, True)
    assert tuple(got[1]) == (None, -7, "-7.5", None, -3.75, -1.5, False)
    assert tuple(got[2]) == (None,) * 7


def test_table_api(spark, catalog):
    t = catalog.table("SpellEffect")
    assert ids(table_api.rows(t, ids=[2, 1], where="SpellID=100").orderBy("ID")) == [1, 2]
    assert ids(table_api.relationship(t, [300])) == [4]
    wanted = spark.createDataFrame([(0, 4), (1, 1), (2, 4)], "ord int, id long")
    assert ids(table_api.lookup(t, wanted, "ID").orderBy("ord")) == [4, 1, 4]
    assert table_api.schema(t)["BasePoints"] == "int"
    q = table_api.TableQuery(catalog.table("SpellName"), "search", column="Name_lang", value="IC")
    assert [r.ID for r in q.run()] == [200] and q.stats == {"rows": 1}
    with pytest.raises(QueryError):
        table_api.parsed_filter(t, "Nope=1")


def test_output(spark, catalog):
    df = catalog.table("SpellEffect").orderBy("ID")
    assert json.loads(output.to_json("sql", df))["data"][2]["BasePoints"] is None
    assert len(list(output.to_jsonl("sql", df))) == 4
    assert list(output.to_csv(df))[3] == "3,200,0,\n"


def test_closure_levels(spark):
    edges = spark.createDataFrame([(100, 200), (200, 300), (300, 300)], "src long, dst long").where("src <> dst")
    found, levels = graph.closure(edges, spark.createDataFrame([(100,)], "node long"), 5)
    assert {tuple(r) for r in found.collect()} == {(100, 0), (200, 1), (300, 2)} and levels == 3


def test_tree(spark):
    rows = [(1, 0, 2, 0, 1, 100), (2, 1, 4, 3, 2, 200), (3, 1, 0, 2, 3, 300), (4, 2, 0, 0, 4, 100), (10, 0, 0, 0, 9, 100), (11, 10, 0, 0, 1, 200), (12, 10, 0, 0, 0, 400)]
    nodes = spark.createDataFrame(rows, "id long, parent long, first_child long, next_sibling long, ord int, spell long")
    walked = tree.paths(nodes.where("parent = 0").select("id", "ord"), tree.child_edges(nodes)).join(nodes.select("id", "spell"), "id")
    assert [r.id for r in walked.orderBy("path").collect()] == [1, 2, 4, 3, 10, 12, 11]
    assert [r.spell for r in tree.preorder_first(walked, "spell").orderBy("path").collect()] == [100, 200, 300, 400]


def test_changelog(spark):
    log = spark.createDataFrame([("p", "1.2.3.44", 1, "enUS", "T", 10, 1, 1), ("p", "1.2.3.44", 1, "enUS", "T", 11, 3, 2), ("p", "44", 1, "enUS", "T", 11, 2, 3)], "product string, build string, region_id int, locale string, table_name string, push_id int, record_id int, unique_id int")
    q = changelog.LogQuery("p", "44", 1, "enUS", latest=True)
    assert [r.record_id for r in changelog.query(log, q).collect()] == [2, 3]
    with pytest.raises(QueryError):
        changelog.LogQuery("p", "44", 1, "enUS").validate()


def test_files(spark):
    lines = spark.createDataFrame([(0, "1;World\\Art/test.blp"), (1, "# c"), (2, ""), (3, "x;y"), (4, "2;a/b.m2"), (5, "1;new/test.blp")], "ord long, value string")
    cat = parse_lines(lines)
    assert {(r.file_data_id, r.path, r.ord) for r in cat.collect()} == {(1, "new/test.blp", 0), (2, "a/b.m2", 4)}
    got = files.by_path(cat, spark.createDataFrame([("A\\B.mdx",), ("nope",)], "name string")).collect()
    assert {tuple(r) for r in got} == {("A\\B.mdx", 2), ("nope", None)}
    assert files.by_extension(cat, ".M2").first().entry == "a/b.m2 [2]"


def test_repeated_paths(spark):
    """A name has all ids of its path, each once, however often the path or the name is there."""
    rows = [(1, "a/b.md"), (2, "A/b.md"), (3, "a/b.md"), (4, " a\\b.md"), (5, "c.mdx"), (6, "c.m2"), (7, "c.m2"), (8, "e.m2"), (9, "e.m2"), (10, None), (11, None), (12, "\u00b5")]
    cat = spark.createDataFrame(rows, "file_data_id long, path string")
    found = lambda *names: sorted((r.name, r.file_data_id) for r in files.by_path(cat, spark.createDataFrame([(n,) for n in names], "name string")).collect())
    assert found("A/B.MD", "A/B.MD", "a\\b.md", "C.mdx", "E.MDL") == [("A/B.MD", 1), ("A/B.MD", 2), ("A/B.MD", 3), ("C.mdx", 5), ("E.MDL", 8), ("E.MDL", 9), ("a\\b.md", 1), ("a\\b.md", 2), ("a\\b.md", 3), ("a\\b.md", 4)]
    assert found("nope") == [("nope", None)] and found(None) == [(None, 10), (None, 11)]
    # every entry asked for by its own path is found once, as the SQL of file_by_path says
    every = files.by_path(cat, cat.select(F.upper("path").alias("name")))
    assert sorted(map(str, every.collect())) == sorted(map(str, cat.select(F.upper("path").alias("name"), "file_data_id").collect()))


def test_paths_of_repeated_pages(spark, tmp_path):
    import duckdb

    from quillspan.plans import catalogue

    spark.createDataFrame([(1, "http://x/a"), (2, "http://x/a"), (3, "http://x/A"), (4, " http://x/a"), (5, None), (6, None), (7, "m.mdx"), (8, "m.m2"), (9, "m.m2")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.queries()["file_by_path"](spark, str(tmp_path)).collect()
    duckdb.read_parquet(f"{tmp_path}/pages.parquet/*.parquet").create_view("repeated_pages")
    want = duckdb.execute(catalogue.oracle_sql()["file_by_path"].replace("FROM pages", "FROM repeated_pages")).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_lookups(spark):
    df = spark.createDataFrame([(1, 5, [3, -1]), (1, 7, [0]), (2, 0, None)], "k long, v long, a array<int>")
    assert {tuple(r) for r in domain.last_value(df, "k", F.col("v"), F.col("v"), "last").collect()} == {(1, 7), (2, 0)}
    assert [r.v for r in domain.first_by(df, "k", ["v"]).orderBy("k").collect()] == [5, 0]
    assert [r[0] for r in df.select(domain.positive(F.col("a"))).collect()] == [[3], [], None]


def test_registered():
    import __spark_entry__ as e

    assert not set(e.oracle_sql()) - set(e.queries())


def test_tree_orders_and_cycles(spark):
    """Places of any size and sign, a node above itself, and more nodes than a recursive query may give."""
    edges = spark.createDataFrame([(1, 2, 10**15), (1, 3, -5), (1, 4, 7), (2, 5, 0), (5, 1, 0)], "parent long, child long, ord long")
    got = tree.paths(spark.createDataFrame([(1, 0)], "id long, ord long"), edges).orderBy("path").collect()
    assert [(r.id, r.depth) for r in got] == [(1, 0), (3, 1), (4, 1), (2, 1), (5, 2)]
    wide = spark.range(1, 1_100_001).select(F.lit(0).cast("long").alias("parent"), F.col("id").alias("child"), F.col("id").alias("ord"))
    assert tree.paths(spark.createDataFrame([(0, 0)], "id long, ord long"), wide).count() == 1_100_001


def test_filter_by_column_type(spark):
    df = spark.createDataFrame([(12, "12", True), (13, "x", False)], "n int, name string, flag boolean")
    count = lambda text: df.where(table_api.parsed_filter(df, text)).count()
    assert (count("name=12"), count("n=12"), count("n=x"), count("flag=true"), count("name=x")) == (1, 1, 0, 1, 1)


def test_page_gaps_across_stretches(spark):
    numbers = [0, 1, 2, 4, 10, 11, 25, 26, 70]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for stretch in (3, 10, 65_536):
        got = sorted((r.page, r.previous) for r in changelog.page_gaps(df, "n", stretch).collect())
        assert got == [(4, 2), (10, 4), (25, 11), (70, 26)]


def test_point_index(spark, tmp_path):
    log = spark.createDataFrame([(t, r, p, f"{t}{r}{p}") for t in range(3) for r in range(50) for p in range(4)], "table_hash long, record_id long, push_id long, v string")
    path = f"{tmp_path}/index"
    changelog.write_index(log, path, "a file of 10 bytes")
    found = changelog.point(spark, path, "a file of 10 bytes", 1, record_id=7)
    assert sorted(r.v for r in found.collect()) == [f"17{p}" for p in range(4)]
    assert "PushedFilters: [IsNotNull(table_hash), IsNotNull(record_id), EqualTo(table_hash,1), EqualTo(record_id,7)]" in found._jdf.queryExecution().toString()
    assert changelog.point(spark, path, "a file of 10 bytes", 2, push_id=3).count() == 50
    with pytest.raises(QueryError):
        changelog.point(spark, path, "a file of 11 bytes", 1)


def test_payloads(spark):
    version = dbd.parse("COLUMNS\nint A\nstring B\nfloat C\n\nBUILD 1.0.0.1\nA<16>\nB\nC[2]\n")
    good = struct.pack("<hI3s2f", -2, 3, b"abc", 0.5, 2.0)
    rows = spark.createDataFrame([(1, good), (2, good[:-1]), (3, None), (4, struct.pack("<hI", 1, 1 << 30))], "id int, raw_data binary")
    got = {r.id: r for r in payload.decoded(rows, version, "1.0.0.1").collect()}
    assert tuple(got[1]["values"]) == (-2, "abc", [0.5, 2.0]) and got[1].error is None
    assert got[2]["values"] is None and got[2].error.startswith("hotfix_schema_mismatch") and got[4].error
    assert got[3]["values"] is None and got[3].error is None
