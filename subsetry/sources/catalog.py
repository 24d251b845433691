"""A database: named tables with keys and relations, over Parquet folders, JDBC or frames."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.plan import Edge, PlanError


@dataclass
class ForeignKey:
    """As declared, of one or more columns."""

    name: str
    table: str
    columns: list[str]
    parent: str
    parent_columns: list[str]
    on_delete: str | None = None
    on_update: str | None = None


@dataclass
class Index:
    """parts: for indexes of more than whole columns in ascending order, each part as its DDL has it."""

    name: str
    columns: list[str]
    unique: bool = False
    kind: str = "btree"
    parts: list[str] | None = None

    def plain(self) -> bool:
        """Whether it is of whole columns, so that a unique one tells rows apart by them."""
        return self.parts is None or all(re.fullmatch(r"[`\"]\w+[`\"]( ASC| DESC)?", p, re.I) for p in self.parts)


@dataclass
class TableMeta:
    """What is known of a table besides its rows. Without a primary key a row is its own key."""

    name: str
    primary_key: list[str] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)  # definitions, where the source's DDL is known

    def unique_keys(self) -> list[list[str]]:
        return ([self.primary_key] if self.primary_key else []) + [i.columns for i in self.indexes if i.unique and i.plain()]


@contextmanager
def views(spark: SparkSession, frames: dict[str, DataFrame]) -> Iterator[dict[str, str]]:
    """Temporary views of frames, for the subqueries of what is analyzed meanwhile; by names of their own."""
    own = f"subsetry_{uuid.uuid4().hex}"
    names = {t: f"{own}_{i}" for i, t in enumerate(frames)}
    try:
        for t, df in frames.items():
            df.createOrReplaceTempView(names[t])
        yield names
    finally:
        for name in names.values():
            spark.catalog.dropTempView(name)


class Catalog:
    """Tables by name. Nothing is read before a frame is used."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], meta: dict[str, TableMeta] | None = None):
        self.spark, self.frames = spark, dict(sorted(frames.items()))
        self.meta = {t: (meta or {}).get(t) or TableMeta(t) for t in self.frames}

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, keys: dict[str, list[str]] | None = None, tables: list[str] | None = None, foreign_keys: list[ForeignKey] | None = None) -> "Catalog":
        """Every <table>.parquet, or <table> folder of Parquet files, of a folder.

        Any file system that Spark reads will do; names come from its listing.
        """
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        if tables is None:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            found = [x.getPath().getName() for x in path.getFileSystem(conf).listStatus(path)]
            tables = [n for n in found if not n.startswith(("_", "."))]
            tables = [n.removesuffix(".parquet") for n in tables if n.endswith(".parquet") or "." not in n]
            suffix = {n.removesuffix(".parquet"): n for n in found}
        else:
            suffix = {t: f"{t}.parquet" for t in tables}
        frames = {t: spark.read.parquet(f"{folder}/{suffix[t]}") for t in tables}
        meta = {t: TableMeta(t, list((keys or {}).get(t, []))) for t in frames}
        for fk in foreign_keys or []:
            meta[fk.table].foreign_keys.append(fk)
        return cls(spark, frames, meta)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: dict[str, str], tables: list[str] | None = None, schema: str | None = None) -> "Catalog":
        """Tables, keys, indexes and foreign keys of a database, through its JDBC driver."""
        from .database import Database

        return Database(spark, url, properties, schema).catalog(tables)

    def described(self, ddl: str) -> "Catalog":
        """This catalog with the metadata of a schema dump for the tables that it tells of."""
        meta = from_ddl(ddl)[1]
        return Catalog(self.spark, self.frames, self.meta | {t: m for t, m in meta.items() if t in self.frames})

    def __contains__(self, table: str) -> bool:
        return table in self.frames

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.frames:
            raise PlanError(f"no table {table!r}")
        return self.frames[table]

    def key(self, table: str) -> list[str]:
        """Columns that tell rows apart: the primary key, or all."""
        return self.meta[table].primary_key or self.frames[table].columns

    def discovered(self) -> list[Edge]:
        """Foreign keys of one column; those of more are kept as metadata only."""
        return [Edge(k.table, k.columns[0], k.parent, k.parent_columns[0]) for m in self.meta.values() for k in m.foreign_keys if len(k.columns) == 1]

    def estimates(self) -> dict[str, int]:
        """Guessed rows of each table, for progress and reports."""
        return {t: estimated_rows(df) for t, df in self.frames.items()}

    def counts(self) -> DataFrame:
        """Rows of each table, as one job."""
        from ..operators.report import table_counts

        return table_counts(self.spark, self.frames)


def estimated_rows(df: DataFrame) -> int:
    """A guess without reading rows: the optimizer's size over that of a row of the schema."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    width = 8 + sum({"long": 8, "double": 8, "timestamp": 8, "string": 20, "binary": 100, "short": 2, "byte": 1, "boolean": 1}.get(f.dataType.typeName(), 4) for f in df.schema.fields)
    return int(int(str(stats.sizeInBytes())) / max(1, width))


_CREATE = re.compile(r"CREATE TABLE (?:IF NOT EXISTS )?[`\"]?(\w[\w-]*)[`\"]?\s*\((.*?)\n\)([^;]*);", re.S | re.I)
_COLUMN = re.compile(r"^\s*[`\"](\w+)[`\"]\s+(.+)$", re.S)
_NAMES = re.compile(r"[`\"](\w+)[`\"]")


def _parts(text: str) -> list[str]:
    """Parts between the commas outside parentheses."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out]


def from_ddl(text: str) -> tuple[dict[str, dict[str, str]], dict[str, TableMeta]]:
    """Columns and metadata of each CREATE TABLE of a schema dump."""
    columns: dict[str, dict[str, str]] = {}
    meta: dict[str, TableMeta] = {}
    for name, body, tail in _CREATE.findall(text):
        own, m = columns.setdefault(name, {}), meta.setdefault(name, TableMeta(name))
        m.options = dict(re.findall(r"(ENGINE|CHARSET|COLLATE|ROW_FORMAT)=(\w+)", tail))
        if "COLLATE" in m.options:
            m.options.setdefault("CHARSET", m.options["COLLATE"].split("_")[0])
        for line in body.split("\n"):
            line = line.strip().rstrip(",")
            head = line.upper()
            if head.startswith("PRIMARY KEY"):
                m.primary_key = _NAMES.findall(line)
            elif fk := re.match(r"CONSTRAINT [`\"](\w+)[`\"] FOREIGN KEY \(([^)]*)\) REFERENCES [`\"](\w+)[`\"] \(([^)]*)\)(.*)", line, re.I):
                act = {k.upper(): v.upper() for k, v in re.findall(r"ON (DELETE|UPDATE) (CASCADE|SET NULL|RESTRICT|NO ACTION)", fk[5], re.I)}
                m.foreign_keys.append(ForeignKey(fk[1], name, _NAMES.findall(fk[2]), fk[3], _NAMES.findall(fk[4]), act.get("DELETE"), act.get("UPDATE")))
            elif ix := re.match(r"(UNIQUE |FULLTEXT |SPATIAL )?(?:KEY|INDEX) [`\"](\w+)[`\"] \((.*)\)(?: USING (\w+))?", line, re.I):
                kind, parts = (ix[1] or "").strip().lower(), _parts(ix[3])
                names = [n[0] for p in parts if (n := _NAMES.findall(p))]
                whole = all(re.fullmatch(r"[`\"]\w+[`\"]", p) for p in parts)
                m.indexes.append(Index(ix[2], names, kind == "unique", kind if kind in ("fulltext", "spatial") else (ix[4] or "btree").lower(), None if whole else parts))
            elif col := _COLUMN.match(line):
                own[col[1]] = m.columns[col[1]] = col[2].strip()
    return columns, meta


def meta_json(meta: dict[str, TableMeta]) -> str:
    from dataclasses import asdict

    return json.dumps({t: asdict(m) for t, m in meta.items()}, indent=1, sort_keys=True)


def meta_from_json(text: str) -> dict[str, TableMeta]:
    out = {}
    for t, m in json.loads(text).items():
        out[t] = TableMeta(m["name"], m["primary_key"], [Index(**i) for i in m["indexes"]], [ForeignKey(**k) for k in m["foreign_keys"]], m["options"], m.get("columns", {}))
    return out
