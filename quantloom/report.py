"""Text of small results. Only aggregates are collected here."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _cell(v) -> str:
    return "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """A Markdown table of the first rows of a report."""
    got = df.limit(rows).collect()
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line([_cell(v) for v in r]) for r in got)])


def health_text(checks: dict[str, DataFrame], ok: str = "ok", rows: int = 20) -> str:
    """One line for each failing row of the checks, or that all is well."""
    out = []
    for name, df in checks.items():
        bad = df.where(f"not {ok}") if ok in df.columns else df
        out += [f"{name}: " + ", ".join(f"{k}={_cell(v)}" for k, v in r.asDict().items() if k != ok) for r in bad.limit(rows).collect()]
    return "\n".join(out) or "all checks passed"


def append(path: str, title: str, *bodies: str) -> None:
    """Appends a section to a local summary file."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(f"## {title}\n\n" + "\n\n".join(bodies) + "\n\n")
