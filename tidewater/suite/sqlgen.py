"""Small helpers that write the DuckDB oracle SQL (strings only)."""

from __future__ import annotations

from collections.abc import Sequence

from tidewater.sources.tables import dirty_cte

DIRTY_COLS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
              ("event_type", "string"), ("value", "double"), ("value_sq", "double"),
              ("pos_n", "double"), ("value_sparse", "double")]
DIRTY_NUMERIC = ["event_id", "user_id", "value", "value_sq", "pos_n", "value_sparse"]

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def with_dirty(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the dirty view CTE (and optional further CTEs)."""
    cte = dirty_cte().rstrip()
    if extra_ctes:
        cte += ",\n" + extra_ctes.strip()
    return cte + "\n" + body.strip()


def r6(expr: str) -> str:
    """Six-decimal rounding written the same way in both engines (see suite.finalize)."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1e6 + 0.5000001) / 1e6 "
            f"ELSE {x} END + 0.0)")


def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def q(name: str) -> str:
    return '"' + name + '"'
