"""Reports from small tables: Markdown and self-contained HTML."""

from __future__ import annotations

import html
import json
from pathlib import Path

import pandas as pd

from lumenframe.params import Params


def _cell(value) -> str:
    return f"{value:.4g}" if isinstance(value, float) else str(value)


def markdown(title: str, tables: dict[str, pd.DataFrame], params: Params | None = None) -> str:
    parts = [f"# {title}"]
    for name, t in tables.items():
        rows = [[_cell(v) for v in r] for r in t.itertuples(index=False)]
        lines = [f"| {' | '.join(map(str, t.columns))} |", f"|{'---|' * len(t.columns)}", *(f"| {' | '.join(r)} |" for r in rows)]
        parts += [f"## {name}", "\n".join(lines)]
    if params:
        parts += ["## Settings", f"```json\n{params.to_json()}\n```"]
    return "\n\n".join(parts) + "\n"


def page(title: str, tables: dict[str, pd.DataFrame], params: Params | None = None) -> str:
    body = []
    for name, t in tables.items():
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in t.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in t.itertuples(index=False))
        body.append(f"<section><h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table></section>")
    if params:
        body.append(f"<section><h2>Settings</h2><pre>{html.escape(params.to_json())}</pre></section>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{''.join(body)}</body></html>"


def write(folder: str, title: str, tables: dict[str, pd.DataFrame], params: Params | None = None, *, spark=None, **facts) -> None:
    """report.md, report.html and result.json in a folder; with a session in one that Spark's file systems reach, such as a shared store."""
    result = json.dumps({"title": title, "tables": {k: json.loads(v.to_json(orient="records")) for k, v in tables.items()}, **facts}, indent=2)
    texts = {"report.md": markdown(title, tables, params), "report.html": page(title, tables, params), "result.json": result}
    if spark is None:
        to = Path(folder)
        to.mkdir(parents=True, exist_ok=True)
        for name, text in texts.items():
            (to / name).write_text(text)
        return
    for name, text in texts.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
