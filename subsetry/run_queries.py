"""Queries of runs, statements, configurations and databases, as in queries, and the SQL they equal."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from . import runtime
from .functions import codecs
from .operators import merge, report
from .operators.anonymize import mask
from .operators.graph import merged_relations, select_tables
from .operators.traverse import Traversal, subset
from .plans.plan import PlanError
from .plans.resolve import load_plan
from .queries import KEYS, catalog, query, root_of
from .sources import infer
from .sources.catalog import Catalog, ForeignKey, TableMeta
from .sources.database import Database
from .sources.files import new_folder
from .sources.target import Target
from .streaming.state import Interrupted

# tables --------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in KEYS))
def listed_tables(spark, sf_dir):
    """Every table that a listing of the folder finds, with its rows."""
    return Catalog.parquet(spark, sf_dir).counts()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE {t})" for t in KEYS))
def discovered_columns(spark, sf_dir):
    found = infer.columns_of(Catalog.parquet(spark, sf_dir))
    return spark.createDataFrame([(t, c) for t, own in found.items() for c in own], "table_name string, column_name string")


@query("SELECT 'Aggregate' AS class, 'orders' AS table_name UNION ALL SELECT 'Aggregate', 'customer' UNION ALL SELECT 'Aggregate', 'nation' UNION ALL SELECT 'Aggregate', 'region' UNION ALL SELECT 'Full', 'supplier' UNION ALL SELECT 'Full', 'part' UNION ALL SELECT 'Excluded', 'lineitem'")
def planned_classes(spark, sf_dir):
    """What a dry run tells of each table before it reads any."""
    names = ("orders", "customer", "nation", "region", "supplier", "part", "lineitem")
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {t: c[t] for t in names}, c.meta)
    found = report.planned(c, load_plan(text="exclude_data lineitem aggregate a { root orders limit 3 }"))
    return found.where("class = 'Excluded' OR estimated_rows > 0").select("class", "table_name")


# predicates and statements as MySQL has them -------------------------------

root_of("root_or_bars", "root customer where \"c_mktsegment = 'BUILDING' || c_acctbal < 0\"", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
root_of("root_xor", "root customer where \"c_mktsegment = 'BUILDING' XOR c_acctbal < 0 # one of them\"", "SELECT * FROM customer WHERE (c_mktsegment = 'BUILDING') <> (c_acctbal < 0)")
root_of("root_mod", "root orders where \"o_orderkey MOD 7 = 3 && o_orderkey--1 > 5\"", "SELECT * FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey + 1 > 5")
root_of(
    "root_joined_subquery", "root customer where \"c_nationkey IN (SELECT n.n_nationkey FROM nation n JOIN region ON region.r_regionkey = n.n_regionkey WHERE r_name LIKE 'A%')\"",
    "SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%')",
)


def after(spark, sf_dir, sql: str, table: str):
    c = catalog(spark, sf_dir)
    return merge.execute(spark, {t: c[t] for t in ("customer", "nation", "orders")}, sql, keys={t: c.meta[t].unique_keys() for t in KEYS})[table]


@query("""SELECT c_custkey, 'again' AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 100
    UNION ALL SELECT * FROM customer WHERE c_custkey >= 100 UNION ALL SELECT 100000000, 'last', 1, 2.5, 'X'""")
def after_replace(spark, sf_dir):
    """Rows with an equal key go; of rows of one statement with an equal key, the last stays."""
    return after(spark, sf_dir, """
        REPLACE INTO customer (c_custkey, c_name, c_nationkey, c_mktsegment) SELECT c_custkey, 'again', c_nationkey, c_mktsegment FROM customer WHERE c_custkey < 100;
        REPLACE INTO customer VALUES (100000000, 'first', 1, 2.5, 'X'), (100000000, 'last', 1, 2.5, 'X')""", "customer")


@query("SELECT c_custkey, c_mktsegment || '/' || CAST(c_nationkey + 1 AS VARCHAR) AS c_name, c_nationkey + 1 AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0 UNION ALL SELECT * FROM customer WHERE NOT c_acctbal > 0")
def after_update_order(spark, sf_dir):
    """A later assignment sees what an earlier one has set."""
    return after(spark, sf_dir, "UPDATE customer SET c_nationkey = c_nationkey + 1, c_name = CONCAT(c_mktsegment, '/', c_nationkey) WHERE c_acctbal > 0", "customer")


@query("SELECT * FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderstatus = 'P')")
def after_delete_many(spark, sf_dir):
    return after(spark, sf_dir, "DELETE FROM orders WHERE o_custkey IN (SELECT c.c_custkey FROM customer c WHERE c.c_acctbal < 0) || o_orderstatus = 'P'", "orders")


# closures over nulls and cycles --------------------------------------------

_LOOSE = "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM orders"
_LOOSE_LINES = "SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_suppkey END AS l_suppkey) FROM lineitem"


def loose(spark, sf_dir) -> Catalog:
    """The catalog with nulls in foreign keys."""
    c = catalog(spark, sf_dir)
    orders = c["orders"].withColumn("o_custkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END"))
    lines = c["lineitem"].withColumn("l_orderkey", F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey END"))
    lines = lines.withColumn("l_suppkey", F.expr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_suppkey END"))
    return Catalog(spark, c.frames | {"orders": orders, "lineitem": lines}, c.meta)


_RN = "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"


@query(f"""WITH o AS ({_LOOSE}), l AS ({_LOOSE_LINES})
    SELECT count(*) AS row_count, sum(l_quantity) AS quantity FROM (SELECT DISTINCT * FROM l
      WHERE l_orderkey IN (SELECT o_orderkey FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN ({_RN})))
         OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN ({_RN})))""")
def null_keys_two_ways(spark, sf_dir):
    """A table without a key is reached on two ways, by columns with nulls."""
    rows = Traversal(loose(spark, sf_dir), load_plan(text='aggregate a { root region where "r_regionkey = 2" }')).run().rows["lineitem"]
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_quantity").alias("quantity"))


@query(f"WITH o AS ({_LOOSE}) SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'P')")
def null_keys_forward(spark, sf_dir):
    return Traversal(loose(spark, sf_dir), load_plan(text="""aggregate a { root orders where "o_orderstatus = 'P'" exclude lineitem }""")).run().rows["customer"]


def tree(spark, sf_dir, where: str):
    """Customers as a tree: each but the first refers to the one with half its number."""
    df = catalog(spark, sf_dir)["customer"].select("c_custkey", F.expr("CASE WHEN c_custkey > 1 THEN CAST(floor(c_custkey / 2) AS BIGINT) END").alias("above"))
    meta = TableMeta("customer", ["c_custkey"], foreign_keys=[ForeignKey("up", "customer", ["above"], "customer", ["c_custkey"])])
    return Traversal(Catalog(spark, {"customer": df}, {"customer": meta}), load_plan(text=f'aggregate a {{ root customer where "{where}" }}')).run().rows["customer"]


@query("""WITH RECURSIVE t AS (SELECT c_custkey, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS above FROM customer),
    down(k) AS (SELECT c_custkey FROM t WHERE c_custkey = 5 UNION SELECT t.c_custkey FROM down JOIN t ON t.above = down.k),
    up(k) AS (SELECT k FROM down UNION SELECT t.above FROM up JOIN t ON t.c_custkey = up.k WHERE t.above IS NOT NULL)
    SELECT * FROM t WHERE c_custkey IN (SELECT k FROM up)""")
def cycle_tree(spark, sf_dir):
    """A table that refers to itself: all below a root, and all above those."""
    return tree(spark, sf_dir, "c_custkey = 5")


# configurations ------------------------------------------------------------

_LANGUAGE = """
    var low: int = 10
    var name: string = "F"
    var ratio: float = 2
    var on: bool
    var kinds: string[] = ["F", "O"]
    #[when($on && !($low > 10) || false)] aggregate a { root orders where "o_orderkey < {$low * 30 + 7 % 4 - -2 / 1} AND o_orderstatus = '{$name}' AND o_orderkey > {($low + 2) * 2}" root_only }
    #[when($ratio < 1.5 || $name != "F")] aggregate b { root orders root_only }
    #[when($ratio >= 2.0 && 1 + 2 * 3 == 7)] aggregate c { root orders where "o_orderstatus = \\"P\\" AND o_orderkey <= 90" root_only }
"""


@query("SELECT * FROM orders WHERE (o_orderkey < 305 AND o_orderstatus = 'F' AND o_orderkey > 24) OR (o_orderstatus = 'P' AND o_orderkey <= 90)")
def conditions_and_operators(spark, sf_dir):
    """Conditions of statements, arithmetic, comparisons, precedence, escapes and interpolation."""
    return Traversal(catalog(spark, sf_dir), load_plan(text=_LANGUAGE, variables={"on": "yes"})).run().rows["orders"]


@query("SELECT * FROM customer WHERE c_custkey <= 40 AND c_nationkey = 3")
def imported_files(spark, sf_dir):
    """A configuration in the language that imports another, and one in JSON with conditions that imports both."""
    with tempfile.TemporaryDirectory() as folder:  # read by the driver only

        def put(name: str, text: str) -> str:
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                f.write(text)
            return f.name

        put("base.conf", "var most: int = 99 var small: bool = true")
        put("middle.conf", 'import "base.conf" var most: int = 40 aggregate a { root customer where "c_custkey <= {$most}" root_only }')
        top = put("top.json", json.dumps({"import": ["middle.conf"], "aggregate": [{"name": "b", "root": "customer", "when": "!$small"}]}))
        plan = load_plan(top)
    return Traversal(catalog(spark, sf_dir), plan).run().rows["customer"].where("c_nationkey = 3")


@query("SELECT problem, n::BIGINT AS n FROM (VALUES ('good', 0), ('bad', 2), ('undefined', 1)) t(problem, n)")
def check_problems(spark, sf_dir):
    """How many problems check finds in configurations; statements after a wrong one are read as well."""
    texts = {"good": "full nation", "bad": "relation a b\nfull part\nvar x int = 3\nfull nation", "undefined": "anonymize nation { n_name -> nobody }"}
    rows = []
    with tempfile.TemporaryDirectory() as folder:
        for name, text in texts.items():
            path = os.path.join(folder, f"{name}.conf")
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            rows.append((name, len(runtime.check(path))))
    return spark.createDataFrame(rows, "problem string, n long")


# masking -------------------------------------------------------------------


@query("SELECT c_custkey, hex(encode('only')) AS raw, 'kept' AS c_name FROM customer")
def mask_binary_and_nulls(spark, sf_dir):
    """A binary column takes a pool's bytes, and nulls are masked like other values."""
    df = catalog(spark, sf_dir)["customer"].select("c_custkey", F.col("c_name").cast("binary").alias("raw"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END").alias("c_name"))
    out = mask(df, [("raw", "p"), ("c_name", "k")], {"p": ["only"], "k": ["kept"]}, ["c_custkey"])
    return out.select("c_custkey", F.hex("raw").alias("raw"), "c_name")


@query("SELECT * EXCLUDE (n) REPLACE ('u' || n AS c_name) FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_nationkey = 4)")
def import_masked(spark, sf_dir):
    """A masked subset as its target holds it."""
    folder = new_folder(spark, "target")
    c = catalog(spark, sf_dir)
    text = 'faker u ["u{unique()}"] anonymize customer { c_name -> u } aggregate a { root customer where "c_nationkey = 4" root_only }'
    runtime.run_import(Catalog(spark, {"customer": c["customer"]}, c.meta), load_plan(text=text), folder)
    return Target(spark, folder)["customer"]


# runs ----------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 'resumed' AS state FROM orders WHERE o_custkey <= 20")
def resumed_import(spark, sf_dir):
    """A run that is interrupted after one table, refused without a word, and resumed."""
    folder = new_folder(spark, "target")
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {t: c[t] for t in ("customer", "nation", "orders", "region")}, c.meta)
    plan = load_plan(text='aggregate a { root customer where "c_custkey <= 20" }')
    state = []
    try:
        runtime.run_import(c, plan, folder, stop_after=1)
    except Interrupted:
        try:
            runtime.run_import(c, plan, folder)
        except PlanError:
            state.append("resumed")
    out = runtime.run_import(c, plan, folder, resume=True)
    if not out.skipped:
        state.clear()
    return Target(spark, folder)["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(",".join(state)).alias("state"))


@query("""SELECT table_name, row_count FROM (
    SELECT 'customer' AS table_name, count(*) AS row_count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey <= 300)
    UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey <= 300 UNION ALL SELECT 'region', 1)""")
def loaded_bundle(spark, sf_dir):
    """A bundle of a closure, loaded into a target, with the plan's later steps carried out there."""
    bundle, folder = new_folder(spark, "bundle"), new_folder(spark, "target")
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {t: c[t] for t in ("customer", "orders", "region")}, c.meta)
    plan = load_plan(text='aggregate a { root orders where "o_orderkey <= 300" } after { "DELETE FROM region WHERE r_regionkey > 0" }')
    runtime.run_export(c, plan, bundle)
    runtime.run_load(spark, bundle, folder)
    return Target(spark, folder).catalog().counts()


@query("SELECT 'written' AS told, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'preserved', count(*) FROM customer WHERE c_custkey < 50")
def run_outcome(spark, sf_dir):
    """What a run tells: rows by step, of which some were preserved."""
    folder = new_folder(spark, "target")
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {"customer": c["customer"]}, c.meta)
    runtime.run_import(c, load_plan(text=""), folder)
    out = runtime.run_import(c, load_plan(text='aggregate a { root customer where "c_acctbal < 0" root_only } preserve customer where "c_custkey < 50"'), folder)
    written = report.by_step(out.timings(spark)).where("step = 'write' AND bytes > 0").select(F.lit("written").alias("told"), F.col("row_count").alias("n"))
    return written.unionByName(spark.createDataFrame([("preserved", out.preserved["customer"])], "told string, n long"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'here' ELSE n_name END AS n_name, n_regionkey, 2::BIGINT AS foreign_keys FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey <= 30)""")
def database_round_trip(spark, sf_dir):
    """Into a database, by the metadata's DDL, and back, with the foreign keys that the database then has."""
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {t: c[t] for t in ("customer", "nation", "region")}, c.meta)
    to = Database(spark, f"jdbc:derby:memory:q{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "APP")
    plan = load_plan(text="""aggregate a { root customer where "c_custkey <= 30" } set nation { match n_nationkey = 3 n_name = "here" }""")
    runtime.run_import(c, plan, to, state=new_folder(spark, "state"))
    return to.read("nation").withColumn("foreign_keys", F.lit(len(to.foreign_keys())).cast("long"))


# relations and codecs ------------------------------------------------------


@query("SELECT child, parent FROM (VALUES ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier'), ('orders', 'customer'), ('labels', 'documents')) t(child, parent)")
def merged_edges(spark, sf_dir):
    """Discovered and declared relations, less ignored ones and those of ignored tables."""
    c = catalog(spark, sf_dir)
    plan = load_plan(text="relation labels.doc_id -> documents.doc_id ignore_relation customer.c_nationkey -> nation.n_nationkey ignore_table region ignore_relation supplier.s_nationkey -> nation.n_nationkey")
    return spark.createDataFrame([(e.child, e.parent) for e in merged_relations(plan, c.discovered(), c.frames)], "child string, parent string")


@query("SELECT * FROM pages")
def tsv_round_trip(spark, sf_dir):
    """Rows as lines with escapes, and back."""
    df = catalog(spark, sf_dir)["pages"]
    return codecs.parsed(codecs.lines(df), df.schema)


@query("SELECT table_name, category FROM (VALUES ('customer_email_log', 'keep'), ('search_tmp', 'exclude_data'), ('session', 'ignore')) t(table_name, category)")
def categories(spark, sf_dir):
    return spark.createDataFrame(list(infer.categorize(["customer_email_log", "search_tmp", "session"]).items()), "table_name string, category string")


@query("SELECT 'orders' AS table_name, count(*) AS row_count FROM orders WHERE o_orderkey <= 200")
def generated_configuration(spark, sf_dir):
    """A configuration that is written from a schema is read again, its root given a predicate."""
    c = catalog(spark, sf_dir)
    c = Catalog(spark, {t: c[t] for t in ("customer", "nation", "orders", "region")}, c.meta)
    text = infer.configuration(infer.columns_of(c), c.meta, c.discovered(), roots=["orders"])
    frames, _ = subset(c, load_plan(text=text.replace("FALSE", "o_orderkey <= 200")))
    return report.table_counts(spark, {"orders": frames["orders"]})


@query("SELECT 'backward' AS way, 2::BIGINT AS tables UNION ALL SELECT 'all', 5")
def static_reach(spark, sf_dir):
    """Tables that a root reaches by relations alone: itself and its children, and their parents."""
    (r,) = select_tables(load_plan(text="aggregate a { root orders exclude part }"), catalog(spark, sf_dir)).reaches
    return spark.createDataFrame([("backward", len(r.backward)), ("all", len(r.tables) - 1)], "way string, tables long")
