"""Literal rows that queries add to those of the given tables."""

#: (end_point) and (path, access_cnt, ord) of the access counts, and what they give
ACCESS_ENDPOINTS = [("/orders/{id}",), ("/orders",), ("/list",), ("/none",), ("",), ("/x/{a}/y",), ("/v.1/{z}",)]
ACCESS_COUNTS = [("/orders/1", 5, 1), ("/orders/22", 7, 2), ("/orders", 3, 3), ("/orders", 9, 4), ("/app/list", 4, 5), ("/b/list", 8, 6), ("/app/x/1/y/z", 2, 7), ("/vx1/3", 100, 8), ("/v.1/3", 6, 9)]
ACCESS_FOUND = [("/orders/{id}", 12), ("/orders", 3), ("/list", 4), ("/none", 0), ("", 0), ("/x/{a}/y", 2), ("/v.1/{z}", 6)]
NAMESPACES = [("ns.o", "OrderDao", "find", "1", 1), ("ns.o", "OldOrderDao", "load", "1", 2), ("ns.f", "FilledDao", "3", "x", 3)]


def values_sql(rows: list[tuple], names: str) -> str:
    """VALUES table of literal rows, for either engine."""
    lit = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({names}))"
