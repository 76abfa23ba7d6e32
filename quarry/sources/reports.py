"""Reports of small aggregates as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sections(title: str, facts: dict[str, object], tables: dict[str, DataFrame]) -> str:
    """Facts as a list, then each two-column table (key, number); tables are roll-ups of bounded size."""
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in facts.items()]]
    for name, rows in tables.items():
        out += ["", f"## {name}", "", *[f"- `{r[0]}`: {r[1]}" for r in rows.collect()]]
    return "\n".join([*out, ""])
