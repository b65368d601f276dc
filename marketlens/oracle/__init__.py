"""Independent SQL for every result, runnable by DuckDB on the same input tables.

``base.sql`` derives the raw, staged and mart tables as common table expressions; the
other files hold one ``-- query: name`` each on top of them. Nothing here is generated from
the Spark plans.
"""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

_HERE = Path(__file__).parent


def _blocks(text: str, mark: str) -> dict[str, str]:
    parts = re.split(rf"^-- {mark}: (\w+)\s*$", text, flags=re.M)
    return {name: body.strip().rstrip(";") for name, body in zip(parts[1::2], parts[2::2], strict=True)}


@cache
def base_tables() -> dict[str, str]:
    return _blocks((_HERE / "base.sql").read_text(), "cte")


def with_base(query: str) -> str:
    """Prefix a query with the base tables it mentions, directly or through others."""
    base = base_tables()
    needed: set[str] = set()
    todo = [query]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in (words & base.keys()) - needed:
            needed.add(name)
            todo.append(base[name])
    if not needed:
        return query
    ctes = [f"{name} AS (\n{body}\n)" for name, body in base.items() if name in needed]
    own = re.match(r"\s*WITH (RECURSIVE )?", query)
    if own:
        return f"WITH {own.group(1) or ''}" + ",\n".join(ctes) + ",\n" + query[own.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + query


@cache
def queries() -> dict[str, str]:
    out: dict[str, str] = {}
    for path in sorted(_HERE.glob("*.sql")):
        if path.name != "base.sql":
            out.update(_blocks(path.read_text(), "query"))
    # @name stands for another query of this folder, as a subquery
    expand = lambda sql: re.sub(r"@(\w+)", lambda m: f"({expand(out[m.group(1)])})", sql)
    return {name: with_base(expand(sql)) for name, sql in out.items()}

