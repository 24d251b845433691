"""Runs from and into a database, by the Derby that Spark carries."""

import functools
import http.server
import importlib.util
import json
import os
import pathlib
import subprocess
import sys
import textwrap
import threading

import pytest
from pyspark.sql import functions as F

from subsetry import runtime
from subsetry.__main__ import main
from subsetry.operators import report
from subsetry.plans.plan import PlanError
from subsetry.plans.resolve import load_plan
from subsetry.sources import ddl, files
from subsetry.sources.catalog import Catalog, Index, TableMeta, from_ddl
from subsetry.sources.database import Database, DatabaseTarget
from subsetry.sources.target import Target
from subsetry.streaming.state import Interrupted

from .shops import shop

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
SOURCE = (
    'CREATE TABLE "people" ("id" BIGINT NOT NULL PRIMARY KEY, "mail" VARCHAR(50), "name" VARCHAR(50))',
    'CREATE UNIQUE INDEX "by_mail" ON "people" ("mail" DESC)',
    'CREATE TABLE "sales" ("id" BIGINT NOT NULL PRIMARY KEY, "who" BIGINT, "state" VARCHAR(10), CONSTRAINT "sales_who" FOREIGN KEY ("who") REFERENCES "people" ("id") ON DELETE CASCADE)',
    'CREATE TABLE "items" ("id" BIGINT NOT NULL PRIMARY KEY, "sale" BIGINT, CONSTRAINT "items_sale" FOREIGN KEY ("sale") REFERENCES "sales" ("id"))',
    """INSERT INTO "people" VALUES (1, 'a@x', 'A'), (2, 'b@x', 'B'), (3, 'c@x', 'C')""",
    """INSERT INTO "sales" VALUES (10, 1, 'new'), (11, 1, 'old'), (12, 2, 'new'), (13, NULL, 'new')""",
    'INSERT INTO "items" VALUES (100, 10), (101, 10), (102, 12), (103, 13)',
)
CONF = """
    faker mails ["user{unique()}@x.test"]
    anonymize people { mail -> mails }
    aggregate a { root sales where "who = 1" }
    preserve people where "mail = 'local'"
    set sales { match id = 10 state = "seen" }
    after { "UPDATE people SET name = CONCAT(name, '!') WHERE id = 1; REPLACE INTO items VALUES (101, 11)" }
"""


def database(spark, name, *statements):
    db = Database(spark, f"jdbc:derby:memory:{name};create=true", DRIVER, "APP")
    try:
        db.execute(*statements)
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            pytest.skip(f"no database: {str(e)[:80]}")
        raise
    return db


@pytest.fixture(scope="module")
def source(spark):
    return database(spark, "from_here", *SOURCE)


def rows(db, table):
    return sorted(map(tuple, db.read(table).collect()), key=str)


def test_a_database_is_described(source):
    c = source.catalog()
    assert list(c.frames) == ["items", "people", "sales"] and c.key("people") == ["id"]
    (fk,) = c.meta["sales"].foreign_keys
    assert (fk.parent, fk.on_delete) == ("people", "CASCADE")
    (index,) = c.meta["people"].indexes
    assert (index.name, index.unique, index.parts) == ("by_mail", True, ['"mail" DESC']) and c.meta["people"].unique_keys() == [["id"], ["mail"]]


def test_import_from_and_into_a_database(spark, source, tmp_path):
    to = database(
        spark, "to_here", 'CREATE TABLE "people" ("id" BIGINT NOT NULL PRIMARY KEY, "mail" VARCHAR(50), "name" VARCHAR(50))',
        """INSERT INTO "people" VALUES (1, 'gone', 'x'), (77, 'local', 'kept')""",
        'CREATE TABLE "notes" ("id" BIGINT, "who" BIGINT, CONSTRAINT "notes_who" FOREIGN KEY ("who") REFERENCES "people" ("id"))',
        'INSERT INTO "notes" VALUES (1, 77)',
        'CREATE TABLE "lost" ("id" BIGINT, "who" BIGINT, CONSTRAINT "lost_who" FOREIGN KEY ("who") REFERENCES "people" ("id"))',
        'INSERT INTO "lost" VALUES (1, 1)',
    )
    with pytest.raises(PlanError):
        runtime.run_import(source.catalog(), load_plan(text=CONF), to)
    out = runtime.run_import(source.catalog(), load_plan(text=CONF), to, state=f"file://{tmp_path}/state")
    assert out.preserved == {"people": 1} and out.rows == {"people": 2, "sales": 2, "items": 2}
    assert rows(to, "people") == [(1, "user0@x.test", "A!"), (77, "local", "kept")]
    assert rows(to, "sales") == [(10, 1, "seen"), (11, 1, "old")] and rows(to, "items") == [(100, 10), (101, 11)]
    # keys of the source and those that the target had are there, and hold
    assert {(k.name, k.parent, k.on_delete) for k in to.foreign_keys()} == {("sales_who", "people", "CASCADE"), ("items_sale", "sales", None), ("notes_who", "people", None), ("lost_who", "people", None)}
    assert out.warnings == [] and to.describe(["people"])["people"].indexes[0].parts == ['"mail" DESC']
    with pytest.raises(Exception, match="foreign key"):
        to.execute('INSERT INTO "sales" VALUES (14, 5, NULL)')
    assert sorted(to.tables()) == ["items", "lost", "notes", "people", "sales"] and not files.exists(spark, f"file://{tmp_path}/state/_state/run.json")
    # a second run finds references that have lost their rows: warnings, and the rest goes on
    out = runtime.run_import(source.catalog(), load_plan(text=CONF.replace("who = 1", "who = 2")), to, state=f"file://{tmp_path}/state")
    assert [w.split(":")[0] for w in out.warnings] == ["foreign key items_sale of items", "foreign key lost_who of lost"] and rows(to, "sales") == [(10, None, "seen"), (12, 2, "new")]


def test_a_failed_load_leaves_the_old_table(spark, source, tmp_path):
    to = database(spark, "stays", 'CREATE TABLE "people" ("id" BIGINT)', 'INSERT INTO "people" VALUES (5)')
    target = DatabaseTarget(to, f"file://{tmp_path}")
    bad = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        target.write("people", bad)
    assert rows(to, "people") == [(5,)] and to.tables() == ["people"]


def test_bundle_into_a_database_and_from_the_web(spark, tmp_path):
    c = shop(spark)
    c = Catalog(spark, {t: c[t] for t in ("users", "orders")}, c.meta)
    runtime.run_export(c, load_plan(text='aggregate a { root orders where "user_id = 1" }'), f"file://{tmp_path}/bundle")
    to = database(spark, "loaded")
    runtime.run_load(spark, f"file://{tmp_path}/bundle", to, state=f"file://{tmp_path}/state")
    assert rows(to, "users") == [(1, "u1@x", "n1", "h")] and len(to.foreign_keys()) == 1
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    handler.log_message = lambda *a: None
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        runtime.run_load(spark, f"http://127.0.0.1:{server.server_port}/bundle", f"file://{tmp_path}/copy")
        server.shutdown()
    assert Target(spark, f"file://{tmp_path}/copy")["orders"].count() == 2


def test_a_run_is_stopped_and_resumed(spark, tmp_path):
    c, plan, states = shop(spark), load_plan(text="ignore_table order_receipts"), []

    def stops(state):
        states.append(state)
        state.stop()

    with pytest.raises(Interrupted):
        runtime.run_import(c, plan, f"file://{tmp_path}", started=stops)
    left = len(states[0].done)
    assert 0 < left < 8
    out = runtime.run_import(c, plan, f"file://{tmp_path}", resume=True)
    assert len(out.skipped) == left and len(out.rows) == 8 and out.rows["order_flags"] == 6
    steps = {r.step: r for r in report.by_step(out.timings(spark)).collect()}
    assert steps["write"].tables == 8 - left and steps["write"].bytes > 0 and "select" in steps


def test_scratch_folders_are_deleted(spark, tmp_path):
    with files.scratch(spark):
        df = files.staged(spark.range(3), "some")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert files.exists(spark, path) and df.count() == 3
    assert not files.exists(spark, path)


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/state.json"
    for text in ("one", "two ö", ""):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert files.names(spark, f"file://{tmp_path}/a") == ["state.json"]


def test_planned_tables(spark):
    text = 'ignore_table sessions exclude_data audit_log aggregate a { root orders where "user_id = 1" exclude order_items }'
    tables = report.planned(shop(spark), load_plan(text=text))
    found = [(r["class"], r["table_name"]) for r in tables.collect()]
    assert found == sorted(found) and ("Ignored", "sessions") in found and ("Excluded", "audit_log") in found and ("Full", "products") in found
    totals = {r["class"]: r for r in report.planned_total(tables).collect()}
    assert totals["Full"].tables == 2 and totals["Full"].estimated_rows > 0 and totals["Excluded"].estimated_rows == 0


DUMP = """
CREATE TABLE `shop_item` (
  `item_id` int unsigned NOT NULL AUTO_INCREMENT,
  `title` varchar(255) NOT NULL DEFAULT 'a,b',
  `body` text,
  `shop_id` int NOT NULL,
  PRIMARY KEY (`item_id`),
  UNIQUE KEY `by_title` (`title`(10) DESC,`shop_id`),
  KEY `by_lower` ((lower(`title`)), `shop_id`) USING HASH,
  FULLTEXT KEY `words` (`body`),
  CONSTRAINT `of_shop` FOREIGN KEY (`shop_id`) REFERENCES `shop` (`shop_id`) ON DELETE CASCADE ON UPDATE SET NULL
) ENGINE=InnoDB COLLATE=utf8mb4_unicode_ci;
CREATE TABLE `shop` (
  `shop_id` int NOT NULL,
  `owner_id` int,
  PRIMARY KEY (`shop_id`)
) ENGINE=InnoDB;
CREATE TABLE `owner` (
  `id` int NOT NULL,
  PRIMARY KEY (`id`)
) ENGINE=InnoDB;
"""


def test_ddl_of_a_dump_comes_back(spark):
    meta = from_ddl(DUMP)[1]["shop_item"]
    assert [i.parts for i in meta.indexes] == [["`title`(10) DESC", "`shop_id`"], ["(lower(`title`))", "`shop_id`"], None]
    assert meta.unique_keys() == [["item_id"]] and meta.options["CHARSET"] == "utf8mb4"
    schema = spark.createDataFrame([], "item_id long not null, title string not null, body string, shop_id int not null").schema
    create = ddl.create_table(meta, schema, {"title"}, foreign_keys=True)[1]
    for part in (
        "`item_id` int unsigned NOT NULL AUTO_INCREMENT", "`title` varchar(255) DEFAULT 'a,b'", "`shop_id` int NOT NULL", "UNIQUE KEY `by_title` (`title`(10) DESC, `shop_id`)",
        "KEY `by_lower` ((lower(`title`)), `shop_id`) USING HASH", "FULLTEXT KEY `words` (`body`)", "ON DELETE CASCADE ON UPDATE SET NULL", "COLLATE=utf8mb4_unicode_ci",
    ):
        assert part in create, part
    assert ddl.add_index(meta, meta.indexes[1], ddl.ANSI) is None and ddl.add_index(meta, Index("i", ["a"], True), ddl.ANSI) == 'CREATE UNIQUE INDEX "i" ON "shop_item" ("a")'
    assert ddl.create_table(TableMeta("t", ["a"]), spark.range(1).withColumnRenamed("id", "a").schema, dialect=ddl.ANSI)[1] == 'CREATE TABLE "t" (\n  "a" BIGINT NOT NULL,\n  PRIMARY KEY ("a")\n)'


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "dump.sql").write_text(DUMP)
    for form, part in (("list", "shop_item.shop_id -> shop.shop_id"), ("grouped", "owner (1)"), ("dot", "digraph"), ("summary", "shop: 2 out, 1 in")):
        assert main(["relations", "--schema-dump", str(tmp_path / "dump.sql"), "--form", form]) == 0
        assert part in capsys.readouterr().out
    assert main(["configure", "--schema-dump", str(tmp_path / "dump.sql"), "--root", "shop"]) == 0
    text = capsys.readouterr().out
    assert "relation shop.owner_id -> owner.id" in text and load_plan(text=text).aggregates[0].table == "shop"


def test_import_command(spark, tmp_path, capsys):
    spark.range(4).write.parquet(f"{tmp_path}/in/numbers.parquet")
    (tmp_path / "vars.json").write_text(json.dumps({"low": 1}))
    (tmp_path / "c.conf").write_text('var low: int aggregate a { root numbers where "id > {$low}" }')
    to = f"jdbc:derby:memory:by_command_{tmp_path.name};create=true"
    common = [str(tmp_path / "c.conf"), "--source", f"file://{tmp_path}/in", "--var-file", str(tmp_path / "vars.json")]
    try:
        database(spark, "probe")
        where = ["--target", to, "--target-property", f"driver={DRIVER['driver']}", "--target-schema", "APP", "--state", f"file://{tmp_path}/state", "--report"]
    except pytest.skip.Exception:
        where = ["--target", f"file://{tmp_path}/out"]
    assert main(["import", *common, *where]) == 0
    assert "1 tables, 2 rows" in capsys.readouterr().out
    (tmp_path / "c.conf").write_text('var low: int aggregate a { root numbers } get above(than: int) { a where "id > {$than}" }')
    assert main(["get", *common, "--target", f"file://{tmp_path}/got", "--", "above", "--than", "2"]) == 0
    assert "1 tables, 1 rows" in capsys.readouterr().out
    assert main(["dry-run", *common]) == 0
    assert "Aggregate" in capsys.readouterr().out


def test_a_database_of_the_driver_on_a_cluster(tmp_path):
    """Executors are JVMs of their own: they do not see a database that the driver has in memory."""
    home = tmp_path / "home"
    home.mkdir()
    for p in pathlib.Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # workers write below Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    (tmp_path / "run.py").write_text(textwrap.dedent("""
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://SHARED/state").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
        from subsetry.run_queries import database_round_trip
        from subsetry.sources.database import Database, DatabaseTarget
        found = sorted(map(tuple, database_round_trip(spark, "/root/testdata/sf0.001").collect()))
        assert found and all(r[1:] == ("here" if r[0] == 3 else r[1], r[2], 2) for r in found), found
        db = Database(spark, "jdbc:derby:memory:many;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "APP")
        df = spark.range(0, 25_001, 1, 3).select("id", F.expr("'ö' || id").alias("name"), F.expr("IF(id % 3 = 0, NULL, id / 4)").alias("x"), F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("day"))
        target = DatabaseTarget(db, "file://SHARED/target")
        assert target.write("many", df) == 25_001 and target.write("none", df.where("id < 0")) == 0
        back = target["many"]
        assert back.dtypes == df.dtypes and back.count() == 25_001 and back.exceptAll(df).isEmpty() and target["none"].isEmpty()
        print("whole")
    """).replace("SHARED", str(tmp_path)))  # fmt: skip
    repo = str(pathlib.Path(__file__).parents[1])
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    ran = subprocess.run([sys.executable, str(tmp_path / "run.py")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "whole" in ran.stdout, ran.stderr[-3000:]
