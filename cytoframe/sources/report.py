"""Reports of short tables: one HTML page, or JSON sections."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import _file_system

_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin-bottom:2em}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}"
#: Most rows of a table that a page shows.
ROWS = 1000


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else escape(str(v))


def html(tables: dict[str, DataFrame], title: str) -> str:
    """A page with a heading and a table for each; meant for short tables: of a longer one it shows ROWS rows, and says so."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(ROWS + 1).collect()
        more = f"<p>The first {ROWS} of {df.count()} rows.</p>" if len(rows) > ROWS else ""
        rows = rows[:ROWS]
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>{more}")
    return "\n".join(parts) + "\n"


def write_html(spark: SparkSession, tables: dict[str, DataFrame], path: str, title: str) -> None:
    fs, p = _file_system(spark, path)
    stream = fs.create(p, True)
    stream.write(bytearray(html(tables, title).encode()))
    stream.close()
