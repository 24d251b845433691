"""Queries over the driver's tables, one or more for each operator, and the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs
from .operators import merge, report
from .operators.anonymize import mask
from .operators.graph import merged_relations, select_tables
from .operators.traverse import Traversal, root_rows, subset
from .plans.plan import Plan, SetRule
from .plans.resolve import load_plan, with_gets
from .runtime import run_import
from .sources import infer
from .sources.catalog import Catalog, ForeignKey
from .sources.files import new_folder
from .sources.target import export_bundle, open_bundle

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
_FOREIGN = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    keys = [ForeignKey(f"{c}_{a}", c, [a], p, [b]) for c, a, p, b in _FOREIGN]
    return Catalog.parquet(spark, sf_dir, KEYS, list(KEYS), keys)


def closure(spark: SparkSession, sf_dir: str, text: str, **variables: object):
    return Traversal(catalog(spark, sf_dir), load_plan(text=text, variables=variables)).run()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rows_of(name: str, table: str, text: str, sql: str) -> None:
    """A query of the rows of one table that a configuration's aggregates reach."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return closure(spark, sf_dir, text).rows[table]

    run.__name__ = name
    query(sql)(run)


# scans and tables ----------------------------------------------------------


@query("SELECT * FROM nation")
def full_scan_nation(spark, sf_dir):
    return subset(catalog(spark, sf_dir), Plan())[0]["nation"]


@query("SELECT * FROM part WHERE false")
def exclude_data_empty(spark, sf_dir):
    return subset(catalog(spark, sf_dir), load_plan(text="exclude_data /^par/"))[0]["part"]


@query("SELECT 'customer' AS table_name, 'Full' AS decision UNION ALL SELECT 'orders', 'Full' UNION ALL SELECT 'pages', 'Excluded' UNION ALL SELECT 'part', 'Excluded'")
def table_patterns(spark, sf_dir):
    """Tables by name and by pattern; those that are not listed are ignored."""
    plan = load_plan(text="ignore_table /^[^cop]/ ignore_table /^con/ exclude_data /^pa/")
    s = select_tables(plan, catalog(spark, sf_dir))
    return spark.createDataFrame([(t, "Full") for t in s.whole] + [(t, "Excluded") for t in s.excluded], "table_name string, decision string")


# roots ---------------------------------------------------------------------

_URGENT = """aggregate a { root orders where "o_orderpriority = '1-URGENT'" order by o_orderkey limit 100 }"""
_R = "WITH r AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 100)"
_L = _R + ", l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM r))"
_C = "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM r)"
_S = "SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)"


def root_of(name: str, body: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = load_plan(text=f"aggregate a {{ {body} }}")
        return root_rows(catalog(spark, sf_dir), plan.aggregates[0])

    run.__name__ = name
    query(sql)(run)


root_of("root_filter", 'root customer where "c_acctbal > 5000 AND c_mktsegment = \'BUILDING\'"', "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
root_of("root_in_subquery", "root customer where \"c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)\"", "SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
root_of(
    "root_interval_rewrite", "root orders where \"o_orderdate > DATE_SUB('1998-08-01', INTERVAL 90 DAY) AND o_orderdate < DATE_ADD('1995-01-01', INTERVAL 5 YEAR)\"",
    "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-08-01' - INTERVAL 90 DAY AND o_orderdate < TIMESTAMP '1995-01-01' + INTERVAL 5 YEAR",
)
root_of("root_like", "root part where \"p_brand LIKE 'Brand#1%' AND p_name NOT LIKE 'x\\_%'\"", "SELECT * FROM part WHERE p_brand LIKE 'Brand#1%'")
root_of("root_false", 'root orders where "FALSE"', "SELECT * FROM orders WHERE false")
root_of("root_topk_desc", "root orders order by o_orderkey desc limit 10", "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10")
root_of("root_topk_asc", "root orders order by o_orderkey asc limit 10", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")

rows_of("root_only", "orders", _URGENT.replace("limit 100", "limit 100 root_only"), _R + " SELECT * FROM r")

# closure -------------------------------------------------------------------

rows_of("fwd_customer", "customer", _URGENT, f"{_R} {_C}")
rows_of("bwd_lineitem", "lineitem", _URGENT, f"{_L} SELECT DISTINCT * FROM l")
rows_of("bwd_then_fwd_part", "part", _URGENT, f"{_L} SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)")
rows_of("bwd_then_fwd_supplier", "supplier", _URGENT, f"{_L} {_S}")
rows_of("no_sibling_pull", "orders", _URGENT, f"{_R} SELECT * FROM r")
rows_of("fwd_nation_two_hops", "nation", _URGENT.replace("limit 100", "limit 3 exclude lineitem"), "WITH r AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 3) SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM r))")
rows_of(
    "fwd_region_three_hops", "region", _URGENT.replace("limit 100", "limit 2 exclude lineitem"),
    "WITH r AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 2) SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM r)))",
)
rows_of("diamond_nation", "nation", _URGENT.replace("limit 100", "limit 2"), f"{_L.replace('LIMIT 100', 'LIMIT 2')} SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM ({_C}) UNION SELECT s_nationkey FROM ({_S}))")

_REGION = 'aggregate a { root region where "r_regionkey = 1" }'
_RN = "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"


@query(f"""
    SELECT count(*) AS row_count, sum(l_quantity) AS quantity FROM (SELECT DISTINCT * FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN ({_RN})))
         OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN ({_RN})))""")
def bwd_chain_region(spark, sf_dir):
    """Region, nation, customer and supplier, orders, lineitem: one table reached on two ways."""
    rows = closure(spark, sf_dir, _REGION).rows["lineitem"]
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").alias("quantity"))


rows_of("soft_relation_events", "events", 'relation events.user_id -> customer.c_custkey aggregate a { root customer where "c_acctbal > 9000" exclude orders }', "SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
rows_of("forward_documents", "documents", 'relation labels.doc_id -> documents.doc_id aggregate a { root labels where "toxic = 1" }', "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")


@query("SELECT 'customer' AS table_name UNION ALL SELECT 'nation' UNION ALL SELECT 'orders' UNION ALL SELECT 'region'")
def ignore_relation(spark, sf_dir):
    """Tables that are reached once a relation is ignored."""
    found = closure(spark, sf_dir, "ignore_relation lineitem.l_orderkey -> orders.o_orderkey " + _URGENT)
    return spark.createDataFrame([(t,) for t in found.rows], "table_name string")


@query(f"{_R}, c AS ({_C}) SELECT 'orders' AS table_name, count(*) AS row_count FROM r UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c) UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))")
def agg_exclude(spark, sf_dir):
    return report.table_counts(spark, closure(spark, sf_dir, _URGENT.replace("limit 100", "limit 100 exclude /^line/")).rows)


@query("SELECT * FROM part")
def full_dead_end(spark, sf_dir):
    """A full table is copied whole, and its rows pull in nothing."""
    return subset(catalog(spark, sf_dir), load_plan(text="full part " + _URGENT))[0]["part"]


@query(f"{_L}, c AS ({_C}) SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)")
def ignored_dead_end(spark, sf_dir):
    return closure(spark, sf_dir, "ignore_table supplier " + _URGENT).rows["nation"]


_TWO = """aggregate a { root orders where "o_orderstatus = 'P'" } aggregate b { root customer where "c_acctbal > 9000" }"""
_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 9000"
_O2 = f"SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN ({_RICH})"
rows_of("multi_aggregate_union", "orders", _TWO, _O2)
rows_of("overlap_dedup", "customer", _TWO, "SELECT * FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
rows_of("nopk_distinct", "lineitem", _TWO, f"SELECT DISTINCT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM ({_O2}))")
rows_of("composite_pk", "conversations", """aggregate a { root conversations where "turn < 2" } aggregate b { root conversations where "role = 'user'" }""", "SELECT * FROM conversations WHERE turn < 2 OR role = 'user'")

_JSON = """{"aggregate": [{"name": "a", "root": "orders", "where": "o_orderstatus = 'F'", "order_by": "o_orderkey", "limit": 20}],
            "include": [{"aggregate": "a", "where": "o_orderstatus = 'P'"}]}"""


@query("SELECT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20) UNION ALL SELECT * FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 20)")
def json_include(spark, sf_dir):
    from .plans.json_config import JsonResolver
    from .plans.resolve import Resolver

    into = Resolver()
    JsonResolver(into).text(_JSON, ".")
    return Traversal(catalog(spark, sf_dir), into.plan).run().rows["orders"]


@query("""
    WITH RECURSIVE n(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 24
      UNION SELECT r.r_regionkey FROM n JOIN nation ON nation.n_nationkey = n.k JOIN region r ON r.r_regionkey = nation.n_regionkey)
    SELECT * FROM nation WHERE n_nationkey IN (SELECT k FROM n)""")
def cycle_fixpoint(spark, sf_dir):
    """A soft relation from region back to nation closes a cycle."""
    text = 'relation region.r_regionkey -> nation.n_nationkey aggregate a { root nation where "n_nationkey = 24" exclude customer, supplier }'
    c = catalog(spark, sf_dir)
    return Traversal(c, load_plan(text=text)).run().rows["nation"]


# masking -------------------------------------------------------------------


def masked(spark: SparkSession, sf_dir: str, table: str, text: str, seed: int | None = None) -> DataFrame:
    plan = load_plan(text=text)
    c = catalog(spark, sf_dir)
    return mask(c[table], plan.anonymize[table], plan.fakers, c.key(table), seed)


@query("SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def mask_null(spark, sf_dir):
    return masked(spark, sf_dir, "customer", "anonymize customer { c_acctbal -> null }")


@query("SELECT c_custkey, 'Same Name' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_fixed_pool(spark, sf_dir):
    return masked(spark, sf_dir, "customer", 'faker n ["Same Name"] anonymize customer { c_name -> n c_name -> null }')


@query("SELECT c_custkey, true AS in_pool FROM customer")
def mask_pool_membership(spark, sf_dir):
    df = masked(spark, sf_dir, "customer", 'faker n ["a", "b", "c"] anonymize customer { c_name -> n }')
    return df.select("c_custkey", F.col("c_name").isin("a", "b", "c").alias("in_pool"))


@query("SELECT c_custkey, CASE WHEN n % 2 = 0 THEN 'user' || n || '@x.test' ELSE 'u' || n || '@y.test' END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)")
def mask_unique(spark, sf_dir):
    return masked(spark, sf_dir, "customer", 'faker e ["user{unique()}@x.test", "u{unique()}@y.test"] anonymize customer { c_name -> e }')


@query("SELECT c_custkey, 'a' || (2 * n) AS c_name, c_nationkey, c_acctbal, 'b' || (2 * n + 1) AS c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer)")
def mask_two_unique_columns(spark, sf_dir):
    return masked(spark, sf_dir, "customer", 'faker a ["a{unique()}"] faker b ["b{unique()}"] anonymize customer { c_mktsegment -> b c_name -> a }')


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_empty_pool(spark, sf_dir):
    return masked(spark, sf_dir, "customer", "var none: string[] = [] faker e $none anonymize customer { c_name -> e }")


@query()
def random_faker_rows(spark, sf_dir):
    """Random values of a pool; no SQL gives the same."""
    return masked(spark, sf_dir, "customer", 'faker n ["x", "y", "z"] anonymize customer { c_name -> n }', seed=7)


# merging -------------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def preserve_or_rules(spark, sf_dir):
    plan = load_plan(text="""preserve customer where "c_mktsegment = 'BUILDING'" preserve customer where "c_acctbal < 0" """)
    return merge.preserved(catalog(spark, sf_dir)["customer"], [w for _, w in plan.preserves])


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'LOCAL' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'LOCAL', 0")
def preserve_replace(spark, sf_dir):
    c = catalog(spark, sf_dir)
    local = c["nation"].where("n_regionkey = 2").withColumn("n_name", F.lit("LOCAL"))
    local = local.unionByName(spark.sql("SELECT 99 AS n_nationkey, 'LOCAL' AS n_name, 0 AS n_regionkey"))
    return merge.replace_rows(c["nation"], local, [c.key("nation")])


def with_set(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    rule: SetRule = load_plan(text=text).sets[0]
    return merge.upsert(catalog(spark, sf_dir)[rule.table], rule)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'new 2' ELSE n_name END AS n_name, n_regionkey FROM nation")
def set_update_all(spark, sf_dir):
    return with_set(spark, sf_dir, 'var n: int = 1 set nation { match n_regionkey = $n n_name = "new {$n + 1}" }')


@query("SELECT * FROM nation UNION ALL SELECT 77, 'added', NULL")
def set_insert(spark, sf_dir):
    return with_set(spark, sf_dir, 'set nation { match n_nationkey = 77, n_name = "added" }')


def after(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return merge.execute(spark, {t: catalog(spark, sf_dir)[t] for t in ("nation", "region")}, sql)[table]


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey > 2 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
def after_update(spark, sf_dir):
    return after(spark, sf_dir, "UPDATE nation SET n_name = CONCAT(UPPER(n_name), '!'), n_regionkey = n_regionkey + 10 WHERE n_regionkey > 2; SELECT 'done'", "nation")


@query("SELECT * FROM nation WHERE NOT (n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))")
def after_delete(spark, sf_dir):
    return after(spark, sf_dir, "DELETE FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')", "nation")


@query("SELECT * FROM region WHERE false")
def after_truncate(spark, sf_dir):
    return after(spark, sf_dir, "TRUNCATE TABLE region", "region")


@query("SELECT * FROM region UNION ALL SELECT 9, 'MOON'")
def after_insert(spark, sf_dir):
    return after(spark, sf_dir, "INSERT INTO region (r_regionkey, r_name) VALUES (9, 'MOON')", "region")


# get functions -------------------------------------------------------------

_GETS = """
    aggregate customers { root customer where "FALSE" }
    aggregate sales { root orders order by o_orderkey desc limit 50 }
    get by_segment (segment: string, low: float = 0) { customers where "c_mktsegment = '{$segment}' AND c_acctbal > {$low}" root_only }
    get latest (max: int = 5) { sales limit $max root_only }
"""


def fetched(spark: SparkSession, sf_dir: str, table: str, *calls: tuple[str, dict]) -> DataFrame:
    plan = with_gets(load_plan(text=_GETS), list(calls))
    return subset(catalog(spark, sf_dir), plan)[0][table]


@query("SELECT * FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 1000.5")
def get_param(spark, sf_dir):
    return fetched(spark, sf_dir, "customer", ("by_segment", {"segment": "MACHINERY", "low": "1000.5"}))


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def get_limit_override(spark, sf_dir):
    return fetched(spark, sf_dir, "orders", ("latest", {"max": "7"}))


# reports -------------------------------------------------------------------

_FLAGSHIP = """aggregate a { root orders where "o_orderpriority = '1-URGENT'" order by o_orderkey limit 100 }"""


@query(f"""{_L}, c AS ({_C}), s AS ({_S}), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s))
    SELECT 'orders' AS table_name, count(*) AS row_count FROM r UNION ALL SELECT 'lineitem', count(*) FROM (SELECT DISTINCT * FROM l)
    UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'part', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)
    UNION ALL SELECT 'supplier', count(*) FROM s UNION ALL SELECT 'nation', count(*) FROM n
    UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)""")
def table_counts(spark, sf_dir):
    """The flagship: a root's whole closure, counted by table."""
    return report.table_counts(spark, closure(spark, sf_dir, _FLAGSHIP).rows)


@query("SELECT 'a' AS aggregate, 'orders' AS root_table, count(*) AS matching_rows, CAST(100 AS BIGINT) AS row_limit FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'b', 'customer', count(*), NULL FROM customer")
def dry_run_counts(spark, sf_dir):
    return report.dry_run(catalog(spark, sf_dir), load_plan(text=_URGENT + " aggregate b { root customer }"))


@query(f"""{_R} SELECT 'customer' AS table_name, 'Aggregate' AS disposition, count(*) AS row_count FROM ({_C})
    UNION ALL SELECT 'lineitem', 'Excluded', 0 UNION ALL SELECT 'orders', 'Aggregate', count(*) FROM r
    UNION ALL SELECT 'nation', 'Full', count(*) FROM nation UNION ALL SELECT 'part', 'Full', count(*) FROM part""")
def dispositions(spark, sf_dir):
    plan = load_plan(text="exclude_data lineitem full nation " + _URGENT)
    c = catalog(spark, sf_dir)
    frames, found = subset(c, plan)
    kept = {t: frames[t] for t in ("customer", "lineitem", "orders", "nation", "part")}
    return report.dispositions(c, kept, found.selection.excluded, found.touched())


@query("SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'orders', 0")
def untouched_full_fallback(spark, sf_dir):
    """Reachable tables that no key reached are copied whole."""
    frames, _ = subset(catalog(spark, sf_dir), load_plan(text='aggregate a { root orders where "FALSE" }'))
    return report.table_counts(spark, {t: frames[t] for t in ("customer", "nation", "orders")})


@query("SELECT 'lineitem' AS table_name, count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) AS dropped FROM lineitem UNION ALL SELECT 'customer', count(*) - count(DISTINCT c_mktsegment) FROM customer")
def dropped_rows_summary(spark, sf_dir):
    c = catalog(spark, sf_dir)
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_mktsegment"], "orders": ["o_orderkey"]}
    return report.dropped_rows(spark, {t: c[t] for t in keys}, keys)


@query("""SELECT table_name, outgoing::BIGINT AS outgoing, incoming::BIGINT AS incoming FROM (VALUES ('lineitem', 3, 0), ('orders', 1, 1), ('customer', 1, 2), ('supplier', 1, 1), ('nation', 1, 2), ('region', 0, 1), ('part', 0, 1), ('events', 1, 0)) t(table_name, outgoing, incoming)""")
def relation_degree(spark, sf_dir):
    c = catalog(spark, sf_dir)
    edges = merged_relations(load_plan(text="relation events.user_id -> customer.c_custkey"), c.discovered(), c.frames)
    return report.relation_degree(spark, edges)


_LOST = "SELECT '{0}' AS child, '{1}' AS child_col, '{2}' AS parent, count(*) AS orphan_count FROM {0} WHERE {1} NOT IN (SELECT {3} FROM {2})"


@query(" UNION ALL ".join(_LOST.format(*f) for f in (*_FOREIGN, ("embeddings", "vec_id", "documents", "doc_id"))))
def fk_orphans(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return report.orphans(c.frames, [*c.discovered(), *load_plan(text="relation embeddings.vec_id -> documents.doc_id").relations], spark)


@query("SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return report.uniqueness(catalog(spark, sf_dir)["lineitem"], ["l_orderkey", "l_linenumber"])


@query("SELECT 'a' AS table_name, CAST(2 AS BIGINT) AS steps, CAST(30 AS BIGINT) AS row_count, CAST(50 AS BIGINT) AS millis UNION ALL SELECT 'b', 1, 5, 70")
def timing_totals(spark, sf_dir):
    return report.by_table(report.timings(spark, [("a", "scan", 10, 20), ("a", "write", 20, 30), ("b", "scan", 5, 70)]))


# sources, sinks, codecs ----------------------------------------------------


@query("SELECT * FROM supplier")
def bundle_roundtrip(spark, sf_dir):
    folder = new_folder(spark, "bundle")
    c = catalog(spark, sf_dir)
    export_bundle(spark, folder, {"supplier": c["supplier"]}, c.meta, Plan())
    return open_bundle(spark, folder)[0]["supplier"]


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'kept' ELSE upper(r_name) END AS r_name FROM region")
def import_with_preserve(spark, sf_dir):
    """Two imports into one target: a local row is kept, and a statement runs on the others."""
    folder = new_folder(spark, "target")
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {"region": c["region"]}, c.meta)
    run_import(c, load_plan(text="""after { "UPDATE region SET r_name = 'kept' WHERE r_regionkey = 1" }"""), folder)
    plan = load_plan(text="""preserve region where "r_name = 'kept'" after { "UPDATE region SET r_name = UPPER(r_name) WHERE r_name <> 'kept'" }""")
    run_import(c, plan, folder)
    from .sources.target import Target

    return Target(spark, folder)["region"]


@query("SELECT n_nationkey, hex(n_name) AS as_hex, n_name AS back FROM nation")
def hex_codec(spark, sf_dir):
    df = catalog(spark, sf_dir)["nation"]
    return df.select("n_nationkey", codecs.to_hex(F.col("n_name")).alias("as_hex"), codecs.from_hex(codecs.to_hex(F.col("n_name"))).cast("string").alias("back"))


@query("SELECT doc_id || chr(9) || replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS value FROM documents")
def tsv_lines(spark, sf_dir):
    return codecs.lines(catalog(spark, sf_dir)["documents"].select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


@query("""SELECT * FROM (VALUES ('labels', 'doc_id', 'documents', 'doc_id')) t(child, child_col, parent, parent_col)""")
def inferred_relations(spark, sf_dir):
    """Of two tables whose keys share a name, the one that the column's stem names is the parent."""
    columns = {"documents": {"doc_id": "bigint"}, "labels": {"id": "bigint", "doc_id": "bigint"}}
    c = catalog(spark, sf_dir)
    meta = {t: c.meta[t] for t in ("documents",)} | {"labels": type(c.meta["labels"])("labels", ["id"])}
    return spark.createDataFrame([(e.child, e.child_col, e.parent, e.parent_col) for e in infer.infer_relations(columns, meta, [])], "child string, child_col string, parent string, parent_col string")


from . import run_queries  # noqa: E402,F401  adds to QUERIES and ORACLES
