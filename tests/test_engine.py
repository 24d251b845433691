import random

import pytest
from pyspark.sql import functions as F
from .shops import organisation, shop

from subsetry import runtime
from subsetry.__main__ import get_calls
from subsetry.functions import codecs
from subsetry.operators import merge, report
from subsetry.operators.anonymize import mask, numbered
from subsetry.operators.graph import components, reach, select_tables, Step
from subsetry.operators.traverse import Traversal, Wanted, lookup, subset
from subsetry.plans.plan import Edge, Plan, PlanError, Root
from subsetry.plans.resolve import load_plan
from subsetry.sources import infer
from subsetry.sources.catalog import Catalog, TableMeta, from_ddl, meta_from_json, meta_json
from subsetry.sources.target import Target, open_bundle
from subsetry.streaming.state import Interrupted


def counts(frames):
    return {t: df.count() for t, df in frames.items()}


USER1 = 'aggregate a { root orders where "user_id = 1" }'


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("ignore_table sessions ignore_table order_audit exclude_data audit_log " + USER1, {"orders": 2, "order_items": 3, "order_flags": 5, "order_receipts": 3, "users": 1, "products": 3}),
        ("ignore_table sessions " + USER1, {"orders": 2, "order_items": 3, "order_flags": 5, "order_receipts": 3, "users": 1, "products": 3, "order_audit": 2}),
        (USER1 + ' aggregate b { root orders where "user_id = 2" }', {"orders": 4, "order_items": 6, "products": 5, "users": 2, "order_flags": 6, "order_receipts": 4, "order_audit": 3}),
        (USER1 + ' aggregate b { root users where "id = 3" exclude sessions }', {"orders": 3, "order_items": 4, "products": 4, "users": 2, "order_flags": 5, "order_receipts": 3, "order_audit": 2}),
        ("full products " + USER1, {"orders": 2, "order_items": 3, "order_flags": 5, "order_receipts": 3, "users": 1, "order_audit": 2}),
        ('aggregate a { root orders where "user_id = 1" exclude order_items }', {"orders": 2, "order_flags": 5, "order_receipts": 3, "users": 1, "order_audit": 2}),
        ('aggregate a { root orders where "user_id = 1" root_only }', {"orders": 2}),
    ],
)
def test_golden_closures(spark, text, expected):
    assert counts(Traversal(shop(spark), load_plan(text=text)).run().rows) == expected


def test_cycles_take_everything(spark):
    rows = Traversal(organisation(spark), load_plan(text="""aggregate a { root departments where "name = 'Engineering'" }""")).run().rows
    assert counts(rows) == {"departments": 4, "employees": 18, "projects": 6, "project_assignments": 21}


def test_whole_import(spark):
    frames, closure = subset(shop(spark), load_plan(text="ignore_table sessions exclude_data audit_log"))
    assert counts(frames) == {"audit_log": 0, "order_audit": 3, "order_flags": 6, "order_items": 7, "order_receipts": 4, "orders": 5, "products": 8, "users": 5}
    frames, closure = subset(shop(spark), load_plan(text='aggregate a { root orders where "FALSE" }'))
    assert counts(frames)["users"] == 5 and counts(frames)["orders"] == 0  # reached by nothing: whole
    frames, _ = subset(shop(spark), load_plan(text='aggregate a { root orders where "FALSE" }'), untouched="empty")
    assert counts(frames)["users"] == 0 and counts(frames)["products"] == 0 and counts(frames)["sessions"] == 2
    frames, closure = subset(shop(spark), load_plan(text='aggregate a { root orders where "user_id = 1" exclude order_items }'))
    assert counts(frames)["products"] == 8 and any("order_items" in w for w in closure.selection.warnings)


def test_selection_errors(spark):
    for text in ("ignore_table orders " + USER1, "exclude_data orders " + USER1, "aggregate a { root nowhere }"):
        with pytest.raises(PlanError):
            select_tables(load_plan(text=text), shop(spark))
    assert any("full" in w for w in select_tables(load_plan(text="full orders " + USER1), shop(spark)).warnings)


def test_reach_is_upgraded_to_backward():
    edges = [Edge("r", "x_id", "x", "id"), Edge("x", "r_id", "r", "id"), Edge("w", "x_id", "x", "id")]
    assert reach(Root("a", "r"), edges, set()).backward == {"r", "x", "w"}
    assert reach(Root("a", "r"), edges[:1] + edges[2:], set()).tables == {"r", "x"}


def test_components_are_ordered():
    steps = [Step("a", "", "b", ""), Step("b", "", "c", ""), Step("c", "", "b", ""), Step("c", "", "d", "")]
    assert components("abcd", steps) == [["a"], ["b", "c"], ["d"]]


def literal_closure(tables, edges, roots, blocked):
    """Level by level, as (table, id) with a mark of whether children are followed."""
    seen, todo = {}, [(r, True) for r in roots]
    while todo:
        (t, i), back = todo.pop()
        if seen.get((t, i), -1) >= back:
            continue
        seen[(t, i)] = int(back)
        for c, col, p in edges:
            if c == t and p not in blocked and tables[t][i].get(col) in tables[p]:
                todo.append(((p, tables[t][i][col]), False))
            if p == t and back and c not in blocked:
                todo += [((c, j), True) for j, row in tables[c].items() if row.get(col) == i]
    return seen


@pytest.mark.parametrize("seed", range(6))
def test_closure_equals_a_literal_one(spark, seed):
    rng = random.Random(seed)
    names = ["t0", "t1", "t2", "t3"][: rng.randint(2, 4)]
    edges = sorted({(rng.choice(names), f"f{k}", rng.choice(names)) for k in range(rng.randint(1, 4))})
    tables = {t: {i: {c: rng.choice([None, *range(1, 9)]) for c in ("f0", "f1", "f2", "f3")} for i in range(1, rng.randint(3, 8))} for t in names}
    blocked = {rng.choice(names[1:])} if rng.random() < 0.3 else set()
    frames = {t: spark.createDataFrame([(i, *r.values()) for i, r in rows.items()], "id long, f0 long, f1 long, f2 long, f3 long") for t, rows in tables.items()}
    plan = Plan(relations=[Edge(c, col, p, "id") for c, col, p in edges], aggregates=[Root("a", "t0", "id <= 2")])
    for b in blocked - {"t0"}:
        plan.full.names.append(b)
    got = Traversal(Catalog(spark, frames, {t: TableMeta(t, ["id"]) for t in names}), plan).run().rows
    found = {(t, r["id"]) for t, df in got.items() for r in df.collect()}
    assert found == set(literal_closure(tables, edges, [("t0", i) for i in (1, 2) if i in tables["t0"]], blocked - {"t0"}))


def test_rows_without_a_key_come_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "b")], "k long, v string")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    c = Catalog(spark, {"child": df, "parent": parent}, {"parent": TableMeta("parent", ["id"])})
    plan = Plan(relations=[Edge("child", "k", "parent", "id")], aggregates=[Root("a", "parent", "id = 1"), Root("b", "child", "v = 'a'")])
    assert sorted(map(tuple, Traversal(c, plan).run().rows["child"].collect()), key=str) == [(1, "a"), (1, None)]
    assert subset(c, Plan())[0]["child"].count() == 5


def test_closure_plan_has_semi_joins_and_no_python(spark):
    rows = Traversal(shop(spark), load_plan(text=USER1)).run().rows
    plan = rows["products"]._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_two_lookups_of_one_table(spark):
    child = [(i, i % 4 or None, i % 3 or None) for i in range(40)] + [(None, 1, 1), (None, 1, 1), (None, None, 2)]
    df = spark.createDataFrame(child, "id int, a int, b int")
    one, two = spark.createDataFrame([(1,), (1,), (None,)], "k int"), spark.createDataFrame([(2,), (None,)], "k int")
    wanted = [Wanted(["a"], one), Wanted(["b"], two)]
    expected = sorted(((i, a, b) for i, a, b in child if a == 1 or b == 2), key=str)
    rows = lookup(df, wanted)
    assert sorted(map(tuple, rows.collect()), key=str) == expected
    keyed = lookup(df.dropna(subset=["id"]), wanted, ["id"])
    assert sorted(map(tuple, keyed.collect()), key=str) == [r for r in expected if r[0] is not None]
    for found in (rows, keyed):  # rows meet keys in semi-joins only, nulls apart from one another
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan and "LeftSemi" in plan and "Cartesian" not in plan
    assert "__salt" in rows._jdf.queryExecution().optimizedPlan().toString()
    same = Wanted(["id", "a", "b"], df.where("id IS NULL"), None, True)
    assert lookup(df, [same, Wanted(["a"], one)]).count() == 3 + sum(1 for i, a, _ in child if a == 1 and i is not None)


# masking -------------------------------------------------------------------


def test_masking(spark):
    df = spark.createDataFrame([(3, "c", None, bytearray(b"x")), (1, "a", 5, None), (2, None, 6, None)], "id long, s string, n int, b binary")
    pools = {"p": ["only"], "u": ["u{unique()}", "v{unique()}-{unique()}"], "n": ["42"], "none": [], "w": ["w{unique()}"]}
    rows = mask(df, [("s", "p"), ("s", None), ("n", "n"), ("b", "p"), ("zz", "p")], pools).orderBy("id").collect()
    assert [(r.s, r.n, bytes(r.b)) for r in rows] == [("only", 42, b"only")] * 3
    assert [r.s for r in mask(df, [("s", "u")], pools, ["id"]).orderBy("id").collect()] == ["u0", "v1-1", "u2"]
    two = mask(df, [("b", "w"), ("s", "w")], pools, ["id"]).orderBy("id").collect()
    assert [(r.s, bytes(r.b).decode()) for r in two] == [("w0", "w1"), ("w2", "w3"), ("w4", "w5")]
    assert mask(df, [("s", "none"), ("n", None)], pools).where("s IS NOT NULL OR n IS NOT NULL").count() == 0
    assert mask(df, [("n", "p")], pools).where("n IS NOT NULL").count() == 0  # a text that is no number
    assert mask(df.limit(0), [("s", "u")], pools, ["id"]).count() == 0


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).withColumn("k", F.abs(F.hash("id")))
    got = [r["n"] for r in numbered(df, ["k", "id"], "n").orderBy("k", "id").collect()]
    assert got == list(range(1000))


# merging -------------------------------------------------------------------


def test_replace_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id long, mail string, v string")
    kept = spark.createDataFrame([(9, "a", "kept"), (3, None, "kept3")], "id long, mail string, v string")
    assert sorted(map(tuple, merge.replace_rows(old, kept, [["id"], ["mail"]]).collect())) == [(2, "b", "y"), (3, None, "kept3"), (9, "a", "kept")]
    rule = load_plan(text='set t { match v = "none", id = 5 mail = "m" }').sets[0]
    assert (5, "m", "none") in set(map(tuple, merge.upsert(old, rule).collect()))
    with pytest.raises(PlanError):
        merge.upsert(old, load_plan(text='set t { match nope = "none" }').sets[0])
    dup = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, m string")
    assert merge.without_collisions(dup, [["id"], ["m"]]).count() == 3


def test_statements(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    out = merge.execute(spark, {"t": t}, "UPDATE t SET s = 'z', id = id + 1 WHERE s IS NULL; DELETE FROM t WHERE id = 1; INSERT INTO t (id) VALUES (7); INSERT INTO t SELECT id * 2, s FROM t WHERE id = 7")
    assert sorted(map(tuple, out["t"].collect()), key=str) == [(14, None), (3, "z"), (7, None)]
    for bad in ("DELETE FROM nowhere", "UPDATE t SET nope = 1", "SELECT nope FROM t"):
        with pytest.raises(Exception):
            merge.execute(spark, {"t": t}, bad)


# runs ----------------------------------------------------------------------


def test_import_resume_preserve(spark, tmp_path):
    folder = f"file://{tmp_path}/target"
    c = shop(spark)
    plan = load_plan(text='faker e ["u{unique()}@x.test"] anonymize users { email -> e password_hash -> null } after { "UPDATE users SET password_hash = \'reset\' WHERE password_hash IS NULL" }')
    assert runtime.run_import(c, plan, folder).rows["users"] == 5
    target = Target(spark, folder)
    assert {r.password_hash for r in target["users"].collect()} == {"reset"} and target["users"].select("email").distinct().count() == 5
    merged = target["users"].unionByName(spark.createDataFrame([(77, "local@x", "me", "keep")], target["users"].schema))
    target.write("users", merged, target.meta["users"])
    keep = load_plan(text="""preserve users where "email = 'local@x'" preserve users where "id = 2" set users { match id = 500 name = "added" }""")
    with pytest.raises(Interrupted):
        runtime.run_import(c, keep, folder, stop_after=9)
    with pytest.raises(PlanError):
        runtime.run_import(c, keep, folder)
    out = runtime.run_import(c, keep, folder, resume=True)
    assert len(out.skipped) == 9
    rows = {r.id: r for r in Target(spark, folder)["users"].collect()}
    assert rows[77].password_hash == "keep" and rows[2].password_hash == "reset" and rows[1].password_hash == "h" and rows[500].name == "added" and len(rows) == 7
    target = Target(spark, folder)
    assert target.superseded()
    target.vacuum()
    assert Target(spark, folder)["users"].count() == 7


def test_collisions_are_told(spark, tmp_path):
    out = runtime.run_import(shop(spark), load_plan(text='faker e ["same"] anonymize users { email -> e }'), f"file://{tmp_path}/t")
    assert out.rows["users"] == 1 and any("4 rows dropped" in w for w in out.warnings)


def test_get_and_bundle(spark, tmp_path):
    c = shop(spark)
    plan = load_plan(text='aggregate o { root orders where "FALSE" } get one_order(id: int) { o where "id = {$id}" } faker n ["x"] anonymize users { name -> n }')
    out = runtime.run_get(c, plan, [("one_order", {"id": "3"})], f"file://{tmp_path}/got")
    assert out.rows == {"orders": 1, "order_items": 2, "order_flags": 1, "order_receipts": 1, "order_audit": 1, "users": 1, "products": 2}
    assert [r.name for r in Target(spark, f"file://{tmp_path}/got")["users"].collect()] == ["x"]
    runtime.run_export(c, load_plan(text=USER1 + ' set users { match id = 9 name = "z" }'), f"file://{tmp_path}/bundle")
    with pytest.raises(PlanError):
        runtime.run_export(c, plan, f"file://{tmp_path}/bundle")
    assert runtime.run_load(spark, f"file://{tmp_path}/bundle", f"file://{tmp_path}/loaded").rows["users"] == 2
    assert Target(spark, f"file://{tmp_path}/loaded").meta["users"].unique_keys() == [["id"], ["email"]]
    (tmp_path / "bundle" / "manifest.json").unlink()
    with pytest.raises(PlanError):
        open_bundle(spark, f"file://{tmp_path}/bundle")


def test_check_and_plan(tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text("var x: int full t")
    bad.write_text("full")
    assert runtime.check(str(good)) == [] and runtime.check(str(bad))
    assert '"names": [' in runtime.plan_json(str(good), {"x": "1"})
    assert get_calls(["a", "--x", "1", "--y=2", "b"]) == [("a", {"x": "1", "y": "2"}), ("b", {})]


# reports, codecs, inference -------------------------------------------------


def test_reports(spark):
    times = report.timings(spark, [("a", "s", 10, 20), ("b", "s", 1, 0), ("a", "w", 5, 80)])
    assert [tuple(r) for r in report.by_table(times).collect()] == [("a", 2, 15, 100), ("b", 1, 1, 0)]
    assert report.slowest(times, 1).first()["rows_per_second"] == 62.5
    assert [r[0] for r in report.unrelated(spark, ["a", "b", "c"], [Edge("a", "x", "b", "y")]).collect()] == ["c"]
    c = shop(spark)
    assert {r["table_name"]: r["row_count"] for r in c.counts().collect()}["order_items"] == 7


def test_codecs(spark):
    df = spark.sql("""SELECT 'a\\tb\\\\n\\n' AS s, CAST(NULL AS string) AS n, X'00ff' AS b, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS d, TIMESTAMP_NTZ '2024-01-02 03:04:05.5' AS t,
        CAST(3.0 AS double) AS x, INTERVAL -'1 02:03:04' DAY TO SECOND AS i""")
    row = codecs.lines(df).first()["value"].split("\t")
    assert row == ["a\\tb\\\\n\\n", "\\N", "00FF", "2024-01-02", "2024-01-02 03:04:05.500000", "3", "-26:03:04"]
    assert df.select(codecs.unescaped(codecs.escaped(F.col("s"))).alias("r")).first()["r"] == df.first()["s"]


DDL = """
CREATE TABLE `store` (
  `store_id` smallint unsigned NOT NULL AUTO_INCREMENT,
  `name` varchar(255) DEFAULT NULL,
  PRIMARY KEY (`store_id`),
  UNIQUE KEY `by_name` (`name`)
) ENGINE=InnoDB CHARSET=utf8mb4;
CREATE TABLE `sales_order` (
  `entity_id` int NOT NULL,
  `store_id` smallint unsigned,
  `customer_id` int,
  `customer_email` varchar(128),
  PRIMARY KEY (`entity_id`),
  CONSTRAINT `fk1` FOREIGN KEY (`store_id`) REFERENCES `store` (`store_id`) ON DELETE SET NULL
) ENGINE=InnoDB;
CREATE TABLE `customer_entity` (
  `entity_id` int NOT NULL,
  `type_id` varchar(10),
  PRIMARY KEY (`entity_id`)
) ENGINE=InnoDB;
CREATE TABLE `report_viewed` (
  `id` int NOT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
"""


def test_inference():
    columns, meta = from_ddl(DDL)
    assert meta["store"].unique_keys() == [["store_id"], ["name"]] and meta["sales_order"].foreign_keys[0].on_delete == "SET NULL"
    assert columns["sales_order"]["customer_email"].startswith("varchar(128)") and meta_from_json(meta_json(meta)) == meta
    known = [Edge("sales_order", "store_id", "store", "store_id")]
    assert infer.infer_relations(columns, meta, known) == [Edge("sales_order", "customer_id", "customer_entity", "entity_id")]
    assert Edge("sales_order", "store_id", "store", "store_id") in infer.infer_relations(columns, meta, [])
    assert infer.categorize(["report_viewed", "x_cl", "a_idx", "store"]) == {"report_viewed": "exclude_data", "x_cl": "ignore", "a_idx": "exclude_data", "store": "keep"}
    text = infer.configuration(columns, meta, known, roots=["sales_order"])
    plan = load_plan(text=text)
    assert plan.anonymize == {"sales_order": [("customer_email", "made_up_mail")]} and plan.exclude_data.names == ["report_viewed"] and plan.aggregates[0].where == "FALSE"
    g = infer.Graph(known, list(columns))
    assert "store (1)" in g.grouped() and "digraph" in g.dot() and "alone: customer_entity" in g.summary() and g.as_list() == "sales_order.store_id -> store.store_id"


def test_parquet_catalog_lists_folders(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/b")
    c = Catalog.parquet(spark, f"file://{tmp_path}", {"a": ["id"]})
    assert list(c.frames) == ["a", "b"] and c.key("b") == ["id"]
    with pytest.raises(PlanError):
        c["missing"]


# statements ----------------------------------------------------------------


@pytest.fixture()
def letters(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, None)], "id int, s string")


def after(spark, df, sql, keys=(("id",),)):
    out = merge.execute(spark, {"r": df, "t": df}, sql, keys={"r": [list(k) for k in keys]})["r"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("REPLACE INTO r VALUES (1, 'new'), (1, 'newer'), (9, 'x')", [(1, "newer"), (2, "b"), (3, "c"), (9, "x"), (None, None)]),
        ("REPLACE INTO r (id) SELECT id FROM t WHERE s = 'b'", [(1, "a"), (2, None), (3, "c"), (None, None)]),
        ("UPDATE r SET id = id + 10, s = CONCAT('v', id)", [(11, "v11"), (12, "v12"), (13, "v13"), (None, None)]),
        ("UPDATE r SET s = (SELECT max(s) FROM t), id = 0 WHERE id IN (SELECT t.id FROM t WHERE t.s = 'b')", [(0, "c"), (1, "a"), (3, "c"), (None, None)]),
        ("DELETE FROM r WHERE s = 'a' || s = 'b'", [(3, "c"), (None, None)]),
        ("DELETE FROM r WHERE id = 1 XOR s > 'a'", [(None, None)]),
        ("DELETE FROM r WHERE id < 3 # not all\n AND id MOD 2 = 0", [(1, "a"), (3, "c"), (None, None)]),
        ("INSERT INTO r (s, id) VALUES ('y', 8); INSERT INTO r (s) VALUES ('z')", [(1, "a"), (2, "b"), (3, "c"), (8, "y"), (None, "z"), (None, None)]),
    ],
)
def test_statements_do_as_mysql_does(spark, letters, sql, expected):
    assert after(spark, letters, sql) == sorted(expected, key=str)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("subsetry_")]


@pytest.mark.parametrize("sql", ["INSERT INTO r VALUES (1, 'again')", "INSERT INTO r (id) VALUES (7), (7)"])
def test_a_key_that_is_there_is_an_error(spark, letters, sql):
    with pytest.raises(PlanError):
        after(spark, letters, sql)
    assert len(after(spark, letters, sql, keys=())) > 4


def test_a_select_is_run_over_all_its_rows(spark, letters):
    assert after(spark, letters, "SELECT CAST(id AS STRING) FROM r") == after(spark, letters, "")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        after(spark, letters.orderBy("id"), "SELECT id, CAST(s AS INT) FROM r")


def test_names_of_tables_in_subqueries(spark):
    from subsetry.operators.predicate import from_views, translate

    names = {"nation": "v0", "region": "v1", "customer": "v2"}
    assert from_views("n IN (SELECT nation FROM nation, region AS r JOIN `customer` c ON c.x = nation.y)", names) == "n IN (SELECT nation FROM `v0` `nation`, `v1` AS r JOIN `v2` c ON c.x = nation.y)"
    assert translate("a XOR b AND c OR d") == "(CAST((a) AS BOOLEAN) <> CAST((b AND c) AS BOOLEAN)) OR d"
    assert translate("x--1") == "x- -1" and translate("1 -- rest\n") == "1  "
    with pytest.raises(PlanError):
        translate("a IN (SELECT x FROM t WHERE p XOR q)")
