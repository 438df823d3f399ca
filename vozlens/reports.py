"""Markdown of small result tables, rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.statistics import br_int, br_number


def _cell(x: object) -> str:
    if x is None:
        return "-"
    if isinstance(x, bool):
        return "sim" if x else "não"
    if isinstance(x, int):
        return br_int(x)
    return br_number(x, 4) if isinstance(x, float) else str(x).replace("|", "\\|")


def table(df: DataFrame, order: list[str], most: int = 200) -> str:
    """A markdown table of at most ``most`` rows; a report's tables are groups, and more of them are named in the last line."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(_cell(x) for x in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ["", "(mais linhas na tabela)"] * (len(rows) > most))


def report(title: str, sections: list[tuple[str, str]], generated_at: str = "") -> str:
    head = [f"# {title}"] + ([f"Gerado em {generated_at}"] if generated_at else [])
    return "\n\n".join([*head, *[f"## {name}\n\n{body}" for name, body in sections]]) + "\n"
