"""The named queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..catalog import Catalog
from ..operators import changelog, domain, files, graph, table_api, tree
from ..sources import dbd, payload
from ..sql import explain, run_sql
from ..storage import new_folder
from . import sql_core

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROLES = {"orders": {"o_orderkey": "id", "o_custkey": "relation"}, "lineitem": {"l_orderkey": "relation"}, "customer": {"c_custkey": "id", "c_nationkey": "relation"}, "part": {"p_partkey": "id"}, "nation": {"n_nationkey": "id", "n_regionkey": "relation"}, "events": {"event_id": "id"}, "pages": {"page_id": "id"}}

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def loaded(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    return Catalog(spark).add_parquet(sf_dir, *(names or TABLES), roles=ROLES)


def query(*tables: str, oracle: str | None = None, name: str | None = None):
    """Registers a function of (catalog) under its name, with the SQL that says the same."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        key = name or f.__name__
        _queries[key] = lambda spark, sf_dir: f(loaded(spark, sf_dir, *tables))
        if oracle:
            _oracles[key] = oracle
        return f

    return register


def _sql(key: str, tables: tuple[str, ...], text: str, params: dict | None) -> None:
    _queries[key] = lambda spark, sf_dir: run_sql(loaded(spark, sf_dir, *tables).spark, text, params)


for _key, _case in sql_core.CASES.items():
    _sql(_key, _case.tables, _case.text, _case.params)
    _oracles[_key] = _case.oracle


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["revenue_by_nation"](spark, sf_dir)


# --- scans and the table interface ---------------------------------------------------------


@query("orders", oracle="SELECT o_orderkey, o_orderstatus, o_totalprice, o_totalprice * 2.0 AS twice FROM orders")
def scan_project(c):
    return table_api.scan(c.table("orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"]).withColumn("twice", F.col("o_totalprice") * 2.0)


@query("orders", oracle="SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (5, 1, 3)")
def id_lookup_batch(c):
    return table_api.rows(c.table("orders"), ids=[5, 1, 3], fields=["o_orderkey", "o_custkey"])


@query("orders", oracle="SELECT w.ord, o_orderkey, o_custkey FROM (VALUES (0, 5), (1, 1), (2, 5), (3, 3)) AS w(ord, id) JOIN orders ON o_orderkey = w.id")
def id_lookup_ordered(c):
    wanted = c.spark.createDataFrame([(0, 5), (1, 1), (2, 5), (3, 3)], "ord int, id long")
    return table_api.lookup(c.table("orders"), wanted, "o_orderkey").select("ord", "o_orderkey", "o_custkey").orderBy("ord")


@query("lineitem", oracle="SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (1, 2, 7)")
def relationship_lookup(c):
    return table_api.relationship(c.table("lineitem"), [1, 2, 7]).select("l_orderkey", "l_partkey", "l_quantity")


@query("orders", oracle="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def predicate_scan(c):
    return table_api.rows(c.table("orders"), where="o_orderstatus=F", fields=["o_orderkey", "o_orderstatus"])


@query("part", oracle="SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def text_search(c):
    return table_api.search(c.table("part"), "p_name", "WIDGET").select("p_partkey", "p_name")


@query("events", oracle="SELECT event_id FROM events WHERE contains(lower(CAST(user_id AS VARCHAR)), '17')")
def text_search_number(c):
    return table_api.search(c.table("events"), "user_id", "17").select("event_id")


@query("region", "nation", "customer", "orders", oracle="SELECT 'region' AS table_name, count(*) AS n_rows, CAST(2 AS BIGINT) AS n_columns FROM region UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def describe_tables(c):
    return c.describe("region", "nation", "customer", "orders")


@query("customer", oracle="SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 100 = 0")
def copy_table_expand(c):
    base = c.table("customer").select("c_custkey", "c_name")
    copies = base.where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1000000).alias("dest"))
    return table_api.expand_copies(base, copies, "c_custkey")


@query("part", oracle="SELECT p_partkey, arg_min(tag, ord) AS tag FROM part JOIN (VALUES (0, 1, 10, 'low'), (1, 5, 25, 'mid'), (2, 20, 50, 'high')) AS r(ord, lo, hi, tag) ON p_size BETWEEN lo AND hi GROUP BY p_partkey")
def schema_range_pick(c):
    ranges = c.spark.createDataFrame([(0, 1, 10, "low"), (1, 5, 25, "mid"), (2, 20, 50, "high")], "ord int, lo int, hi int, tag string")
    return c.table("part").join(ranges, F.col("p_size").between(F.col("lo"), F.col("hi"))).groupBy("p_partkey").agg(F.min_by("tag", "ord").alias("tag"))


@query("orders", oracle="WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS gap FROM orders) SELECT o_custkey, o_orderkey, CAST(sum(gap) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS decoded FROM g")
def delta_decode(c):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gaps = c.table("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") - F.coalesce(F.lag("o_orderkey").over(w), F.lit(0))).alias("gap"))
    return gaps.select("o_custkey", "o_orderkey", F.sum("gap").over(w).alias("decoded"))


# --- functions -------------------------------------------------------------------------------


@query("part", oracle=r"SELECT p_partkey FROM part WHERE (p_name || '_x') LIKE '%\_x' ESCAPE '\' AND NOT (p_name LIKE '%\_%' ESCAPE '\')")
def like_percent_only(c):
    named = c.table("part").withColumn("tagged", F.concat("p_name", F.lit("_x")))
    return named.where(fn.like_percent(F.col("tagged"), "%_x") & ~fn.like_percent(F.col("p_name"), "%_%")).select("p_partkey")


@query("part", oracle="SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, CAST(length(p_name) AS BIGINT) AS len, lower(CAST(p_size AS VARCHAR)) AS size_text FROM part")
def fn_string(c):
    return c.table("part").select("p_partkey", F.lower("p_name").alias("low"), F.upper("p_brand").alias("up"), fn.code_points(F.col("p_name")).alias("len"), F.lower(fn.as_text(F.col("p_size"))).alias("size_text"))


@query("events", oracle="SELECT event_id, TRY_CAST(event_type AS BIGINT) AS as_int, CAST(trunc(value) AS BIGINT) AS whole, TRY_CAST(event_type AS DOUBLE) AS as_double, CASE WHEN user_id IN (0, 1) THEN user_id = 1 END AS as_bool, CAST(user_id AS VARCHAR) AS as_text FROM events")
def fn_cast(c):
    e = c.table("events")
    return e.select("event_id", fn.lenient_cast(F.col("event_type"), "INT").alias("as_int"), fn.lenient_cast(F.col("value"), "BIGINT").alias("whole"), fn.lenient_cast(F.col("event_type"), "REAL").alias("as_double"), fn.lenient_cast(F.col("user_id"), "BOOL").alias("as_bool"), fn.lenient_cast(F.col("user_id").cast("double"), "TEXT").alias("as_text"))


@query("lineitem", oracle="SELECT l_orderkey, l_partkey, l_linenumber, l_quantity + l_linenumber AS s, l_quantity - l_linenumber AS d, l_quantity * l_linenumber AS p, l_quantity / NULLIF(CAST(l_linenumber - 1 AS DOUBLE), 0) AS q, CAST(l_orderkey AS DOUBLE) % NULLIF(CAST(l_linenumber - 1 AS DOUBLE), 0) AS r, -l_quantity AS n FROM lineitem")
def fn_arith(c):
    x = c.table("lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return x.select("l_orderkey", "l_partkey", "l_linenumber", fn.add(q, n).alias("s"), fn.subtract(q, n).alias("d"), fn.multiply(q, n).alias("p"), fn.divide(q, n - 1).alias("q"), fn.modulo(F.col("l_orderkey"), n - 1).alias("r"), (-q).alias("n"))


# --- graphs and trees ------------------------------------------------------------------------

_EDGES = "SELECT p_partkey AS src, (p_partkey * 7 + 13) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size % 5 = 0"


def part_edges(c: Catalog) -> DataFrame:
    part = c.table("part")
    n = part.agg(F.count("*").alias("n"))
    first = part.crossJoin(n).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 13) % F.col("n")).alias("dst"))  # one row
    return graph.typed_edges([first, part.where("p_size % 5 = 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))])


_CLOSURE = f"WITH RECURSIVE e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst), w(node, depth) AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0), (2, 0)) UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 5) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node"


def _seeds(c: Catalog) -> DataFrame:
    return c.spark.createDataFrame([(1,), (2,)], "node long")


@query("part", oracle=_CLOSURE)
def closure_bfs(c):
    return graph.closure(part_edges(c), _seeds(c), 5)[0].select("node", F.col("depth").cast("long").alias("depth"))


@query("part", oracle="SELECT CAST(5 AS BIGINT) AS levels")
def chain_depth(c):
    return graph.level_rows(c.spark, graph.closure(part_edges(c), _seeds(c), 5)[1])


@query("part", oracle=f"SELECT dst AS node, count(*) AS n_sources, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM (SELECT DISTINCT * FROM ({_EDGES}) WHERE src <> dst) GROUP BY dst")
def closure_reverse(c):
    return graph.reverse_edges(part_edges(c))


@query("pages", oracle="SELECT DISTINCT page_id AS src, ref FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS ref FROM pages) WHERE ref <> ''")
def text_refs(c):
    return graph.text_edges(c.table("pages"), "page_id", F.col("html"), 'href="/([^"]+)"')


_TREE = "SELECT 'r' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0') AS path, CAST(0 AS BIGINT) AS depth, CAST(r_regionkey AS BIGINT) AS key FROM region UNION ALL SELECT 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') || '/n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0'), 1, n_nationkey FROM nation UNION ALL SELECT 'r' || lpad(CAST(n_regionkey AS VARCHAR), 9, '0') || '/n' || lpad(CAST(n_nationkey AS VARCHAR), 9, '0') || '/c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 2, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"


def walked(c: Catalog) -> DataFrame:
    """Regions, nations and customers as one tree, with 10^10 and 2 x 10^10 added to tell the kinds of ids apart."""
    nation, customer = c.table("nation"), c.table("customer")
    big = 10**10
    roots = c.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_regionkey").alias("ord"))
    edges = nation.select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + big).alias("child"), F.col("n_nationkey").alias("ord")).union(customer.select((F.col("c_nationkey") + big).alias("parent"), (F.col("c_custkey") + 2 * big).alias("child"), F.lit(0).alias("ord")))
    key = F.pmod(F.col("id"), F.lit(big))
    return tree.paths(roots, edges).withColumn("key", key)


@query("region", "nation", "customer", oracle=_TREE)
def tree_paths(c):
    part = lambda x: F.lpad(F.pmod(F.split(x, "/")[1].cast("long"), F.lit(10**10)).cast("string"), 9, "0")
    kinds = F.array(F.lit("r"), F.lit("n"), F.lit("c"))
    return walked(c).select(F.array_join(F.transform("path", lambda x, i: F.concat(kinds[i], part(x))), "/").alias("path"), F.col("depth").cast("long").alias("depth"), "key")


@query("region", "nation", "customer", oracle=f"SELECT path, k FROM (SELECT path, key % 7 AS k, row_number() OVER (PARTITION BY key % 7 ORDER BY path) AS n FROM ({_TREE}) WHERE key % 7 <> 0) WHERE n = 1".replace("SELECT path, k FROM", "SELECT k, split_part(path, '/', 1) AS top FROM"))
def preorder_first(c):
    first = tree.preorder_first(walked(c).withColumn("k", F.col("key") % 7), "k")
    return first.select("k", F.concat(F.lit("r"), F.lpad(F.split(F.col("path")[0], "/")[1].cast("long").cast("string"), 9, "0")).alias("top"))


# --- lookups ----------------------------------------------------------------------------------


@query("events", oracle="SELECT user_id, bool_or(event_type = 'error') AS has_error FROM events GROUP BY user_id")
def flag_any(c):
    return domain.has_any(c.table("events"), "user_id", F.col("event_type") == "error", "has_error")


@query("events", oracle="SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id % 5 = 0")
def flag_filter(c):
    return c.table("events").where((F.col("event_type") == "click") & (F.col("user_id") % 5 == 0)).select("event_id", "user_id")


@query("embeddings", oracle="SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE embedding[1] > 0")
def flag_filter_first(c):
    x = domain.first_element(F.col("embedding"), True)
    return c.table("embeddings").where(x > 0).select("vec_id", x.cast("double").alias("first"))


@query("region", "nation", oracle="SELECT r_name, n_name, nth FROM (SELECT r_name, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS INTEGER) AS nth FROM nation JOIN (SELECT * FROM region WHERE contains(lower(r_name), 'asia') ORDER BY lower(r_name) <> 'asia', length(r_name), r_name LIMIT 1) ON n_regionkey = r_regionkey) WHERE nth = 2")
def rank_pick(c):
    region = domain.resolve_name(c.table("region"), "r_name", " Asia ")
    return domain.nth_child(c.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_regionkey", ["n_name", "n_nationkey"], 2).select("r_name", "n_name", "nth")


@query("part", "supplier", oracle="SELECT p_partkey, coalesce(s_name, 'Unknown supplier #' || p_partkey) AS supplier, coalesce(CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END, 'other') AS size_name, p_type LIKE 'BOW%' AS is_bow FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def lookup_defaults(c):
    df = domain.with_default(c.table("part"), c.table("supplier"), F.col("s_suppkey") == F.col("p_partkey"), {"supplier": F.coalesce("s_name", F.concat(F.lit("Unknown supplier #"), F.col("p_partkey").cast("string")))})
    return df.select("p_partkey", "supplier", domain.named(F.col("p_size"), {1: "one", 2: "two"}, F.lit("other")).alias("size_name"), F.col("p_type").startswith("BOW").alias("is_bow"))


@query("orders", "customer", "nation", oracle="SELECT c_custkey, last_order, n_name FROM (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def last_wins_chain(c):
    last = domain.last_value(c.table("orders"), "o_custkey", F.col("o_orderkey"), F.col("o_orderkey"), "last_order")
    return last.join(c.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(c.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "last_order", "n_name")


@query("embeddings", oracle="SELECT vec_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY v DESC, pos) AS top FROM (SELECT vec_id, pos, v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) <= 3) GROUP BY vec_id")
def explode_rank_collect(c):
    from pyspark.sql import Window

    each = c.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("v"), "pos"))).where("n <= 3")
    return domain.gathered(top, "vec_id", F.col("pos"), [F.col("n")], "top")


@query("orders", "lineitem", oracle="SELECT o_custkey, string_agg(CAST((l_linenumber + 1) * 100 + CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS codes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def display_group(c):
    j = c.table("orders").join(c.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return domain.gathered(j, "o_custkey", domain.variation(F.col("l_linenumber"), F.col("l_quantity").cast("bigint")), [F.col(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "codes")


@query("customer", "nation", "orders", oracle="SELECT c.c_custkey, i.pos, min(o.o_orderkey) AS o_orderkey FROM customer c, (VALUES (0), (1), (2)) AS i(pos) JOIN orders o ON o.o_custkey = c.c_custkey + i.pos GROUP BY 1, 2".replace("FROM customer c, (VALUES (0), (1), (2)) AS i(pos) JOIN", "FROM customer c CROSS JOIN (VALUES (0), (1), (2)) AS i(pos) JOIN"))
def candidate_models(c):
    arrays = c.table("customer").select("c_custkey", F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.col("c_custkey") + i).alias("wanted"))
    return domain.candidates(arrays, "c_custkey", "wanted", c.table("orders"), "o_custkey", "o_orderkey")


@query("documents", oracle="SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes, 'text/plain' AS mime FROM documents")
def export_manifest(c):
    return c.table("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit("text/plain").alias("mime"))


# --- path catalogue and change log --------------------------------------------------------------


def _paths(c: Catalog) -> DataFrame:
    return c.table("pages").select(F.col("page_id").alias("file_data_id"), F.col("url").alias("path"), F.col("page_id").alias("ord"))


@query("pages", oracle="SELECT page_id AS file_data_id, lower(replace(trim(url), chr(92), '/')) AS path FROM pages")
def listfile_parse(c):
    from ..sources.listfile import parse_lines

    lines = _paths(c).select(F.col("ord"), F.concat(F.col("file_data_id").cast("string"), F.lit(";"), F.col("path")).alias("value"))
    return parse_lines(lines).select("file_data_id", files.normalized(F.col("path")).alias("path"))


@query("pages", oracle="SELECT w.id AS file_data_id, coalesce(url, 'unknown') AS path FROM (VALUES (1), (2), (-5)) AS w(id) LEFT JOIN pages ON page_id = w.id")
def file_lookup(c):
    return files.by_id(_paths(c), c.spark.createDataFrame([(1,), (2,), (-5,)], "file_data_id int"))


@query("pages", oracle="SELECT upper(url) AS name, page_id AS file_data_id FROM pages")
def file_by_path(c):
    return files.by_path(_paths(c), c.table("pages").select(F.upper("url").alias("name")))


@query("pages", oracle="SELECT page_id AS file_data_id, url AS path FROM pages WHERE contains(lower(url), 'blog') ORDER BY page_id LIMIT 20")
def file_search(c):
    return files.search(_paths(c), "BLOG", 20).select("file_data_id", "path")


@query("pages", oracle="SELECT url || ' [' || page_id || ']' AS entry FROM pages WHERE lower(url) LIKE '%.html'")
def file_extension(c):
    return files.by_extension(_paths(c), ".html").orderBy("entry")


@query("pages", "documents", oracle="SELECT page_id AS file_data_id FROM pages WHERE page_id IN (SELECT doc_id * 2 FROM documents)")
def file_exists(c):
    return files.present(_paths(c), c.table("documents").select((F.col("doc_id") * 2).alias("file_data_id"))).select("file_data_id")


@query("part", "supplier", "customer", oracle="WITH r AS (SELECT p_partkey % 50 AS id, p_partkey % 20 AS ckey, p_partkey AS ord FROM part WHERE (p_size & 2) <> 0 AND (p_size & 128) = 0), f AS (SELECT id, arg_min(ckey, ord) AS ckey FROM r GROUP BY id) SELECT id AS file_data_id, f.ckey, s_suppkey + 100 AS ekey, s_acctbal AS size, c_nationkey AS archive FROM f JOIN supplier ON s_suppkey = f.ckey LEFT JOIN customer ON c_custkey = s_suppkey + 100")
def flags_resolve(c):
    root = c.table("part").select((F.col("p_partkey") % 50).alias("file_data_id"), (F.col("p_partkey") % 20).alias("ckey"), F.col("p_size").alias("locale_flags"), F.col("p_size").alias("content_flags"), F.col("p_partkey").alias("ord"))
    encoding = c.table("supplier").select(F.col("s_suppkey").alias("ckey"), (F.col("s_suppkey") + 100).alias("ekey"), F.col("s_acctbal").alias("size"))
    archives = c.table("customer").select(F.col("c_custkey").alias("ekey"), F.col("c_nationkey").alias("archive"))
    return files.resolved(root, encoding, archives, files.LOCALE_BITS["enUS"]).select("file_data_id", "ckey", "ekey", "size", "archive")


def _log(c: Catalog) -> DataFrame:
    return c.table("events").select(F.lit("p").alias("product"), F.concat(F.lit("1.15.7."), (F.col("user_id") % 3 + 60000).cast("string")).alias("build"), F.lit(1).alias("region_id"), F.lit("enUS").alias("locale"), F.col("event_type").alias("table_name"), F.col("user_id").alias("push_id"), F.col("event_id").alias("record_id"), F.col("event_id").alias("unique_id"), (F.col("event_id") % 6).alias("status"), F.col("ts").alias("created_at"))


@query("events", oracle="SELECT event_id AS record_id, user_id AS push_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1")
def log_filter(c):
    q = changelog.LogQuery("p", "60001", 1, "enUS", table_name="click")
    return changelog.query(_log(c), q).select("record_id", "push_id")


@query("events", oracle="SELECT event_id AS record_id, user_id AS push_id FROM events WHERE event_type = 'click' AND user_id % 3 = 1 AND user_id = (SELECT max(user_id) FROM events WHERE event_type = 'click' AND user_id % 3 = 1)")
def log_latest_batch(c):
    q = changelog.LogQuery("p", "60001", 1, "enUS", table_name="click", latest=True)
    return changelog.query(_log(c), q).select("record_id", "push_id")


@query("events", oracle="SELECT event_id AS record_id, user_id AS push_id FROM events WHERE user_id % 3 = 2 ORDER BY user_id, event_id LIMIT 25 OFFSET 50")
def log_page(c):
    q = changelog.LogQuery("p", "1.15.7.60002", 1, "enUS", latest=False, start=datetime(1970, 1, 1), page=2, limit=25)
    return changelog.query(_log(c), q).select("record_id", "push_id")


@query("conversations", oracle="SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def log_dedupe_guard(c):
    return changelog.repeated_ids(c.table("conversations"), "conv_id")


@query("orders", oracle="SELECT page, previous FROM (SELECT page, lag(page) OVER (ORDER BY page) AS previous FROM (SELECT DISTINCT o_orderkey * 3 // 2 AS page FROM orders)) WHERE page <> previous + 1")
def log_page_gap(c):
    return changelog.page_gaps(c.table("orders").select(F.expr("o_orderkey * 3 div 2").alias("n")).distinct(), "n")


@query("events", oracle="SELECT event_id % 6 AS status, count(*) AS n FROM events WHERE event_id % 6 NOT IN (1, 2, 3, 4) GROUP BY 1")
def log_unknown_status(c):
    return changelog.unknown_status(_log(c), "status").groupBy("status").agg(F.count("*").alias("n"))


@query("events", oracle="SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS VARCHAR) AS id_text, event_type AS kind FROM events")
def json_named_positional(c):
    e = c.table("events")
    payload = F.to_json(F.array(F.col("event_id").cast("string"), "event_type"))
    m = changelog.positional(payload, ["ID", "Kind"])
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), m["ID"].alias("id_text"), m["Kind"].alias("kind"))


@query("events", oracle="SELECT event_id AS record_id, user_id AS push_id FROM events WHERE event_type = 'click' AND event_id % 100 = 7")
def log_point_index(c):
    """A copy sorted for point queries, asked for every hundredth record of one table."""
    path = new_folder(c.spark)
    log = _log(c).withColumn("table_hash", F.xxhash64("table_name")).withColumn("record_id", F.col("record_id") % 100)
    changelog.write_index(log, path, "events")
    table = c.spark.range(1).select(F.xxhash64(F.lit("click"))).first()[0]
    return changelog.point(c.spark, path, "events", table, record_id=7).select(F.col("unique_id").alias("record_id"), "push_id")


_PAYLOAD = dbd.parse("COLUMNS\nint Key\nfloat Price\nstring Status\nint Pair\n\nBUILD 1.0.0.1\nKey<64>\nPrice\nStatus\nPair<u16>[2]\n")


@query("orders", oracle="SELECT o_orderkey, o_orderkey AS key, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS price, o_orderstatus AS status, CAST(o_orderkey % 60000 AS BIGINT) AS first, CAST(o_custkey % 500 AS BIGINT) AS second FROM orders")
def payload_decode(c):
    """Binary payloads made of orders, read back by their definition."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in ("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")), strict=True)
            data = [struct.pack("<qfI", k, p, len(s.encode())) + s.encode() + struct.pack("<HH", k % 60000, u % 500) for k, p, s, u in rows]
            yield pa.RecordBatch.from_arrays([b.column("o_orderkey"), pa.array(data, pa.binary())], ["o_orderkey", "raw_data"])

    rows = c.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey").mapInArrow(made, "o_orderkey long, raw_data binary")
    v = "values."
    return payload.decoded(rows, _PAYLOAD, "1.0.0.1").select("o_orderkey", F.col(v + "Key").cast("long").alias("key"), F.col(v + "Price").cast("double").alias("price"), F.col(v + "Status").alias("status"), F.col(v + "Pair")[0].cast("long").alias("first"), F.col(v + "Pair")[1].cast("long").alias("second"))


@query("orders")
def explain_plan(c):
    return explain(c.spark, "SELECT o_orderkey FROM orders WHERE o_orderkey = :k", {"k": 1})


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
