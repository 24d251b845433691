"""Fixtures: a shop and an organisation with cyclic foreign keys."""

from subsetry.sources.catalog import Catalog, ForeignKey, Index, TableMeta

SHOP_FKS = [
    ForeignKey("a", "orders", ["user_id"], "users", ["id"]),
    ForeignKey("b", "order_items", ["order_id"], "orders", ["id"]),
    ForeignKey("c", "order_items", ["product_id"], "products", ["id"]),
    ForeignKey("d", "sessions", ["user_id"], "users", ["id"]),
    ForeignKey("e", "order_flags", ["order_id"], "orders", ["id"]),
    ForeignKey("f", "order_receipts", ["order_id"], "orders", ["id"]),
    ForeignKey("g", "order_audit", ["order_id"], "orders", ["id"]),
]


def shop(spark) -> Catalog:
    rows = {
        "users": ("id long, email string, name string, password_hash string", [(i, f"u{i}@x", f"n{i}", "h") for i in range(1, 6)]),
        "products": ("id long, sku string, price decimal(10,2)", [(i, f"s{i}", None) for i in range(1, 9)]),
        "orders": ("id long, user_id long, status string", [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 2, "c"), (5, 3, "a")]),
        "order_items": ("id long, order_id long, product_id long", [(1, 1, 1), (2, 1, 5), (3, 2, 2), (4, 3, 4), (5, 3, 7), (6, 4, 1), (7, 5, 3)]),
        "audit_log": ("id long, action string", [(1, "x"), (2, "y"), (3, "z")]),
        "sessions": ("id string, user_id long", [("s1", 1), ("s2", 2)]),
        "order_flags": ("order_id long, flag string", [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "y"), (3, "x")]),
        "order_receipts": ("id long, order_id long, scan binary", [(1, 1, bytearray(b"\xff")), (2, 1, bytearray(b"")), (3, 2, None), (4, 3, None)]),
        "order_audit": ("id long, order_id long", [(1, 1), (2, 2), (3, 3)]),
    }
    meta = {t: TableMeta(t, [] if t == "order_flags" else ["id"]) for t in rows}
    meta["users"].indexes.append(Index("email", ["email"], True))
    for k in SHOP_FKS:
        meta[k.table].foreign_keys.append(k)
    return Catalog(spark, {t: spark.createDataFrame(d, s) for t, (s, d) in rows.items()}, meta)


# Who works in which project.
ASSIGNMENTS = [(1, 6), (1, 8), (1, 9), (1, 11), (2, 7), (2, 10), (2, 12), (3, 11), (3, 13), (3, 8), (4, 14), (4, 15), (4, 9), (5, 17), (5, 18), (5, 10), (6, 2), (6, 6), (6, 7), (6, 8), (6, 9)]


def organisation(spark) -> Catalog:
    people = {1: (1, None), 2: (1, 1), 3: (2, 1), 4: (3, 1), 5: (4, 1), 6: (1, 2), 7: (1, 2), 8: (1, 6), 9: (1, 6), 10: (1, 7), 11: (2, 3), 12: (2, 3), 13: (2, 11), 14: (3, 4), 15: (3, 4), 16: (3, 14), 17: (4, 5), 18: (4, 5)}
    rows = {
        "departments": ("id long, name string, head_employee_id long", [(1, "Engineering", 2), (2, "Sales", 3), (3, "Ops", 4), (4, "HR", 5)]),
        "employees": ("id long, department_id long, manager_id long", [(i, d, m) for i, (d, m) in people.items()]),
        "projects": ("id long, department_id long, lead_employee_id long", [(1, 1, 6), (2, 1, 7), (3, 2, 11), (4, 3, 14), (5, 4, 17), (6, 1, 2)]),
        "project_assignments": ("id long, project_id long, employee_id long", [(i, *x) for i, x in enumerate(ASSIGNMENTS, 1)]),
    }
    fks = [("departments", "head_employee_id", "employees"), ("employees", "department_id", "departments"), ("employees", "manager_id", "employees"), ("projects", "department_id", "departments"), ("projects", "lead_employee_id", "employees"), ("project_assignments", "project_id", "projects"), ("project_assignments", "employee_id", "employees")]
    meta = {t: TableMeta(t, ["id"], foreign_keys=[ForeignKey(f"{c}_{a}", c, [a], p, ["id"]) for c, a, p in fks if c == t]) for t in rows}
    return Catalog(spark, {t: spark.createDataFrame(d, s) for t, (s, d) in rows.items()}, meta)
