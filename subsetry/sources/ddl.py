"""DDL of a table's metadata, for targets that take SQL."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampNTZType, TimestampType

from .catalog import ForeignKey, Index, TableMeta

_TYPES = {
    BooleanType: "TINYINT(1)", ShortType: "SMALLINT", IntegerType: "INT", LongType: "BIGINT", FloatType: "FLOAT", DoubleType: "DOUBLE",
    StringType: "LONGTEXT", BinaryType: "LONGBLOB", DateType: "DATE", TimestampType: "DATETIME(6)", TimestampNTZType: "DATETIME(6)",
}


@dataclass(frozen=True)
class Dialect:
    """How a kind of database spells what the DDL needs."""

    quote: str
    types: dict = field(default_factory=dict)
    other: str = "JSON"  # for types without a counterpart
    own_columns: bool = False  # whether column definitions of a source's DDL are understood
    rename: str = "ALTER TABLE {} RENAME TO {}"

    def quoted(self, name: str) -> str:
        return self.quote + name.replace(self.quote, self.quote * 2) + self.quote

    def names(self, columns: list[str]) -> str:
        return ", ".join(map(self.quoted, columns))

    def sql_type(self, kind: DataType, key: bool = False) -> str:
        """The column type; text in a key needs a length."""
        if isinstance(kind, DecimalType):
            return f"DECIMAL({min(kind.precision, 31)},{kind.scale})" if self is not MYSQL else f"DECIMAL({kind.precision},{kind.scale})"
        if key and isinstance(kind, StringType):
            return "VARCHAR(255)"
        return self.types.get(type(kind), self.other)


MYSQL = Dialect("`", _TYPES, own_columns=True, rename="RENAME TABLE {} TO {}")
#: What most other databases take.
ANSI = Dialect('"', _TYPES | {BooleanType: "BOOLEAN", FloatType: "REAL", StringType: "VARCHAR(32672)", BinaryType: "BLOB", TimestampType: "TIMESTAMP", TimestampNTZType: "TIMESTAMP"}, "VARCHAR(32672)")


DERBY = replace(ANSI, rename="RENAME TABLE {} TO {}")


def dialect_of(url: str) -> Dialect:
    return MYSQL if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else DERBY if url.startswith("jdbc:derby:") else ANSI


def _index_parts(index: Index, dialect: Dialect) -> str:
    if not index.plain():
        return ", ".join(index.parts)  # prefixes and expressions are MySQL's own
    falls = [bool(index.parts) and index.parts[i].upper().endswith(" DESC") for i in range(len(index.columns))]
    return ", ".join(dialect.quoted(c) + " DESC" * down for c, down in zip(index.columns, falls))


def index_clause(index: Index) -> str:
    """The index as a clause of MySQL's CREATE TABLE, or after ALTER TABLE ... ADD."""
    kind = {"fulltext": "FULLTEXT ", "spatial": "SPATIAL "}.get(index.kind, "UNIQUE " if index.unique else "")
    return f"{kind}KEY {MYSQL.quoted(index.name)} ({_index_parts(index, MYSQL)})" + (" USING HASH" if index.kind == "hash" else "")


def add_index(meta: TableMeta, index: Index, dialect: Dialect = MYSQL) -> str | None:
    """The statement that adds the index; None where the dialect has none of its kind."""
    if dialect is MYSQL:
        return f"ALTER TABLE {dialect.quoted(meta.name)} ADD {index_clause(index)}"
    if not index.plain() or index.kind in ("fulltext", "spatial"):
        return None
    return f"CREATE {'UNIQUE ' if index.unique else ''}INDEX {dialect.quoted(index.name)} ON {dialect.quoted(meta.name)} ({_index_parts(index, dialect)})"


def foreign_key_clause(fk: ForeignKey, dialect: Dialect = MYSQL) -> str:
    name = f"CONSTRAINT {dialect.quoted(fk.name)} " if fk.name else ""
    out = f"{name}FOREIGN KEY ({dialect.names(fk.columns)}) REFERENCES {dialect.quoted(fk.parent)} ({dialect.names(fk.parent_columns)})"
    return out + "".join(f" ON {what} {act}" for what, act in (("DELETE", fk.on_delete), ("UPDATE", fk.on_update)) if act)


def create_table(meta: TableMeta, schema: StructType, relaxed: set[str] = frozenset(), foreign_keys: bool = False, dialect: Dialect = MYSQL, indexes: bool = True) -> list[str]:
    """DROP and CREATE. relaxed columns may be NULL, as masking clears them; foreign keys come
    with the table only if asked for, else add_foreign_keys adds them after all tables."""
    keyed = {c for k in (meta.primary_key, *(i.columns for i in meta.indexes)) for c in k}
    name, lines = dialect.quoted(meta.name), []
    for f in schema.fields:
        required = f.name in meta.primary_key or (not f.nullable and f.name not in relaxed)
        if dialect.own_columns and f.name in meta.columns:
            own = meta.columns[f.name]
            lines.append(f"{dialect.quoted(f.name)} {own.replace(' NOT NULL', '') if f.name in relaxed and not required else own}")
        else:
            lines.append(f"{dialect.quoted(f.name)} {dialect.sql_type(f.dataType, f.name in keyed)}{' NOT NULL' if required else ' NULL' if dialect is MYSQL else ''}")
    if meta.primary_key:
        lines.append(f"PRIMARY KEY ({dialect.names(meta.primary_key)})")
    if indexes and dialect is MYSQL:
        lines += map(index_clause, meta.indexes)
    if foreign_keys:
        lines += [foreign_key_clause(fk, dialect) for fk in meta.foreign_keys]
    options = "".join(f" {k}={v}" for k, v in sorted(meta.options.items())) if dialect is MYSQL else ""
    return [f"DROP TABLE IF EXISTS {name}", f"CREATE TABLE {name} (\n  " + ",\n  ".join(lines) + f"\n){options}"]


def add_foreign_keys(meta: TableMeta, dialect: Dialect = MYSQL) -> list[str]:
    return [f"ALTER TABLE {dialect.quoted(meta.name)} ADD {foreign_key_clause(fk, dialect)}" for fk in meta.foreign_keys]
