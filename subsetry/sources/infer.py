"""Relations, kinds of tables and sensitive columns, guessed from names; graphs and configurations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from ..plans.plan import Edge
from .catalog import Catalog, TableMeta

# Affixes of entity tables, names and affixes of transient tables, sensitive columns.
ENTITY_PREFIXES = ("catalog_", "sales_", "customer_", "")
ENTITY_SUFFIXES = ("_entity", "_flat")
IGNORED_NAMES = ("session", "cache", "cache_tag", "cron_schedule")
IGNORED_SUFFIXES = ("_cl",)
EMPTIED_NAMES = (
    "queue_lock", "queue_poison_pill", "queue_message", "queue_message_status", "captcha_log", "customer_log", "customer_visitor",
    "oauth_nonce", "oauth_token_request_log", "password_reset_request_event", "sendfriend_log", "data_exporter_uuid", "importexport_importdata",
)
EMPTIED_SUFFIXES = ("_tmp", "_idx", "_replica", "_aggregated")
EMPTIED_PREFIXES = ("report_", "reporting_")
EMPTIED_PARTS = ("_aggregated_", "_data_exporter_")
EMPTIED_ENDS = (("payment_services_", "_submitted_hash"),)
SENSITIVE = {
    "email": ("email", "customer_email", "subscriber_email", "template_sender_email"),
    "name": (
        "firstname", "lastname", "first_name", "last_name", "customer_firstname", "customer_lastname", "billing_firstname",
        "billing_lastname", "shipping_firstname", "shipping_lastname",
    ),
    "address": ("street", "billing_street", "shipping_street"),
    "phone": ("telephone", "fax", "billing_telephone", "billing_fax", "shipping_telephone", "shipping_fax"),
    "postcode": ("postcode", "billing_postcode", "shipping_postcode"),
    "ip": ("remote_ip", "x_forwarded_for", "remote_ip_long", "ip"),
    "token": ("password", "password_hash", "rp_token", "session_data", "access_token", "access_token_hash"),
}
POOLS = {"email": "made_up_mail", "name": "made_up_people", "address": "made_up_places", "phone": "made_up_numbers", "postcode": "made_up_zips", "ip": None, "token": None}

Columns = dict[str, dict[str, str]]


@dataclass
class Correction:
    """A guess that is known to be wrong: dropped, or pointed elsewhere if that table exists."""

    column: str
    child_prefix: str = ""
    parent: str | None = None
    instead: tuple[str, str] | None = None

    def applies(self, e: Edge) -> bool:
        return e.child_col == self.column and e.child.startswith(self.child_prefix) and self.parent in (None, e.parent)


# Guesses that shop schemas are known to mislead.
CORRECTIONS = (
    Correction("type_id", "catalog_product"),
    Correction("customer_id", parent="login_as_customer_assistance_allowed", instead=("customer_entity", "entity_id")),
    Correction("order_id", parent="sales_order_confirm_cancel", instead=("sales_order", "entity_id")),
    Correction("rule_id", "catalogrule_", "authorization_rule", ("catalogrule", "rule_id")),
)


def columns_of(catalog: Catalog) -> Columns:
    return {t: {f.name: f.dataType.simpleString() for f in df.schema.fields} for t, df in catalog.frames.items()}


def infer_relations(columns: Columns, meta: dict[str, TableMeta], known: list[Edge], corrections: tuple[Correction, ...] = CORRECTIONS) -> list[Edge]:
    """A relation for each *_id column without one whose parent a rule finds.

    Rules in turn: the one other table whose key has the column's name; of several, the one
    whose name is, or ends in, the column's stem; a table of the stem's name; an entity table
    of the stem. Only tables with keys of one column are parents.
    """
    key = {t: m.primary_key[0] for t, m in meta.items() if len(m.primary_key) == 1}
    taken = {(e.child, e.child_col) for e in known}

    def parent(table: str, column: str) -> str | None:
        stem = column.removesuffix("_id")
        same = [t for t in key if key[t] == column and t != table]
        if len(same) > 1:
            same = [t for t in same if t == stem or t.endswith("_" + stem)]
        if len(same) == 1:
            return same[0]
        named = [stem] + [p + stem + s for s in ENTITY_SUFFIXES for p in ENTITY_PREFIXES]
        return next((t for t in named if t in key), None)

    out = []
    for table, own in columns.items():
        for column, kind in own.items():
            if not column.endswith("_id") or (table, column) in taken:
                continue
            if column in meta[table].primary_key and (column == "entity_id" or "auto_increment" in kind.lower()):
                continue
            to = parent(table, column)
            if to is None:
                continue
            e = Edge(table, column, to, key[to])
            if e.child == e.parent:
                continue
            fix = next((c for c in corrections if c.applies(e)), None)
            if fix is None:
                out.append(e)
            elif fix.instead and fix.instead[0] in columns:
                out.append(Edge(table, column, *fix.instead))
            elif fix.instead:
                out.append(e)
    return out


def categorize(tables: list[str]) -> dict[str, str]:
    """ignore, exclude_data or keep for each table, by its name."""
    out = {}
    for t in tables:
        if t in IGNORED_NAMES or t.endswith(IGNORED_SUFFIXES):
            out[t] = "ignore"
        elif (
            t in EMPTIED_NAMES or t.endswith(EMPTIED_SUFFIXES) or t.startswith(EMPTIED_PREFIXES)
            or any(p in t for p in EMPTIED_PARTS) or any(t.startswith(a) and t.endswith(b) for a, b in EMPTIED_ENDS)
        ):
            out[t] = "exclude_data"
        else:
            out[t] = "keep"
    return out


def sensitive_columns(columns: Columns, kinds: dict[str, str]) -> dict[str, dict[str, str]]:
    """Of tables that are kept: each sensitive column's category."""
    category = {c: k for k, names in SENSITIVE.items() for c in names}
    found = {t: {c: category[c] for c in own if c in category} for t, own in columns.items() if kinds.get(t) == "keep"}
    return {t: own for t, own in found.items() if own}


def _ident(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else f"`{name}`"


def configuration(columns: Columns, meta: dict[str, TableMeta], known: list[Edge], pools: dict[str, list[str]] | None = None, roots: list[str] | None = None) -> str:
    """A configuration: pools, handling of tables, relations, masking, and empty aggregates of roots."""
    kinds = categorize(list(columns))
    own_pools = {
        "made_up_mail": ["user{unique()}@example.test"], "made_up_people": ["Alex", "Robin", "Sam"], "made_up_places": ["1 Test Street"],
        "made_up_numbers": ["+10000000000"], "made_up_zips": ["00000"],
    } | (pools or {})
    out = [f"faker {n} [" + ", ".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values) + "]" for n, values in own_pools.items()]
    out.append("")
    out += [f"ignore_table {_ident(t)}" for t, k in kinds.items() if k == "ignore"] + [f"exclude_data {_ident(t)}" for t, k in kinds.items() if k == "exclude_data"]
    for e in infer_relations(columns, meta, known):
        if "ignore" not in (kinds[e.child], kinds[e.parent]):
            out.append(f"relation {_ident(e.child)}.{_ident(e.child_col)} -> {_ident(e.parent)}.{_ident(e.parent_col)}")
    for t, own in sensitive_columns(columns, kinds).items():
        out += ["", f"anonymize {_ident(t)} {{", *(f"    {_ident(c)} -> {POOLS[k] or 'null'}" for c, k in own.items()), "}"]
    for t in roots or []:
        out += ["", f"aggregate {_ident(t)} {{", f"    root {_ident(t)}", '    where "FALSE"', "}"]
    return "\n".join(out) + "\n"


# graphs --------------------------------------------------------------------


@dataclass
class Graph:
    edges: list[Edge]
    tables: list[str] = field(default_factory=list)

    def as_list(self) -> str:
        return "\n".join(f"{e.child}.{e.child_col} -> {e.parent}.{e.parent_col}" for e in sorted(self.edges, key=lambda e: (e.child, e.child_col)))

    def grouped(self) -> str:
        """Parents, each with the columns that refer to it."""
        parents: dict[str, list[str]] = {}
        for e in self.edges:
            parents.setdefault(e.parent, []).append(f"{e.child}.{e.child_col}")
        return "\n".join(f"{p} ({len(c)})\n" + "\n".join(f"  <- {x}" for x in sorted(c)) for p, c in sorted(parents.items()))

    def dot(self) -> str:
        rows = [f'  "{e.child}" -> "{e.parent}" [label="{e.child_col}"];' for e in self.edges]
        return "digraph relations {\n" + "\n".join(rows) + "\n}"

    def summary(self, group: Callable[[str], str] = lambda t: t.split("_")[0]) -> str:
        """For each group of tables of a prefix how often it refers and is referred to, and tables without relations."""
        out, into = Counter(group(e.child) for e in self.edges), Counter(group(e.parent) for e in self.edges)
        named = {t for e in self.edges for t in (e.child, e.parent)}
        alone = sorted(set(self.tables) - named)
        rows = [f"{len(self.tables)} tables, {len(self.edges)} relations, {len(alone)} tables without any"]
        rows += [f"{g}: {out[g]} out, {into[g]} in" for g in sorted({*out, *into}, key=lambda g: (-out[g] - into[g], g))]
        return "\n".join(rows + [f"alone: {t}" for t in alone])
