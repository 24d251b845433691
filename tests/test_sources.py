import pytest
from pyspark.sql import functions as F

from subsetry.operators.traverse import Traversal
from subsetry.plans.plan import Edge
from subsetry.plans.resolve import load_plan
from subsetry.sources.catalog import Catalog, ForeignKey, Index, TableMeta
from subsetry.sources.ddl import add_foreign_keys, create_table
from subsetry.sources.target import write_jdbc

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
URL = "jdbc:derby:memory:shop;create=true"


@pytest.fixture(scope="module")
def database(spark):
    """A database in the driver's memory, by the Derby that Spark carries."""
    jvm = spark._jvm
    try:
        jvm.java.lang.Class.forName(DRIVER["driver"])
        con = jvm.java.sql.DriverManager.getConnection(URL)
    except Exception as e:
        pytest.skip(f"no database: {str(e)[:80]}")
    s = con.createStatement()
    for sql in (
        "CREATE TABLE customers (id BIGINT NOT NULL PRIMARY KEY, mail VARCHAR(50))",
        "CREATE UNIQUE INDEX by_mail ON customers (mail)",
        "CREATE TABLE sales (id BIGINT NOT NULL PRIMARY KEY, customer_id BIGINT, a INT NOT NULL, b INT NOT NULL, CONSTRAINT fk_c FOREIGN KEY (customer_id) REFERENCES customers (id), CONSTRAINT u_ab UNIQUE (a, b))",
        "CREATE TABLE notes (a INT, b INT, CONSTRAINT fk_ab FOREIGN KEY (a, b) REFERENCES sales (a, b))",
        "INSERT INTO customers VALUES (1, 'x'), (2, 'y')",
        "INSERT INTO sales VALUES (10, 1, 1, 1), (11, 2, 1, 2), (12, NULL, 2, 2)",
        "INSERT INTO notes VALUES (1, 1)",
    ):
        s.execute(sql)
    s.close()
    con.close()
    return URL


def test_jdbc_catalog(spark, database):
    c = Catalog.jdbc(spark, database, DRIVER, schema="APP")
    assert list(c.frames) == ["CUSTOMERS", "NOTES", "SALES"]
    assert c.key("SALES") == ["ID"] and c.meta["NOTES"].primary_key == []
    assert ["MAIL"] in c.meta["CUSTOMERS"].unique_keys()
    assert c.meta["NOTES"].foreign_keys[0].columns == ["A", "B"]
    assert c.discovered() == [Edge("SALES", "CUSTOMER_ID", "CUSTOMERS", "ID")]  # the one of two columns is metadata only
    rows = Traversal(c, load_plan(text='aggregate a { root CUSTOMERS where "ID = 2" }')).run().rows
    assert [r.ID for r in rows["SALES"].collect()] == [11]


def test_jdbc_load(spark, database):
    write_jdbc({"copied": spark.range(5).withColumn("v", F.lit("x"))}, database, DRIVER)
    assert spark.read.jdbc(database, "copied", properties=DRIVER).count() == 5


def test_estimates(spark, tmp_path):
    spark.range(10_000).write.parquet(f"{tmp_path}/t.parquet")
    c = Catalog.parquet(spark, f"file://{tmp_path}")
    assert 100 < c.estimates()["t"] < 1_000_000


def test_ddl(spark):
    meta = TableMeta("t`x", ["id"], [Index("u", ["mail"], True), Index("f", ["body"], kind="fulltext")], [ForeignKey("fk", "t`x", ["a", "b"], "p", ["c", "d"], "CASCADE")], {"ENGINE": "InnoDB"})
    schema = spark.createDataFrame([], "id long not null, mail string not null, body string, price decimal(10,2), at timestamp, raw binary").schema
    drop, create = create_table(meta, schema, {"mail"})
    assert drop == "DROP TABLE IF EXISTS `t``x`"
    for part in ("`id` BIGINT NOT NULL", "`mail` VARCHAR(255) NULL", "`price` DECIMAL(10,2) NULL", "`raw` LONGBLOB NULL", "PRIMARY KEY (`id`)", "UNIQUE KEY `u` (`mail`)", "FULLTEXT KEY `f` (`body`)", ") ENGINE=InnoDB"):
        assert part in create
    assert add_foreign_keys(meta) == ["ALTER TABLE `t``x` ADD CONSTRAINT `fk` FOREIGN KEY (`a`, `b`) REFERENCES `p` (`c`, `d`) ON DELETE CASCADE"]
