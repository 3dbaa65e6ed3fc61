"""Plain text for people and agents; inputs are pages of bounded size."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def hits(rows: DataFrame, lines: int = 8) -> str:
    out = []
    for i, r in enumerate(rows.collect(), 1):
        d = r.asDict()
        text = "\n".join((d.get("content") or "").split("\n")[:lines])
        out.append(f"{i}. {d.get('symbol_name') or d.get('chunk_id')} {d.get('relative_path') or ''}:{d.get('start_line') or ''} ({d.get('score', 0):.3f}) [{','.join(d.get('sources') or [])}]" + (f"\n{text}" if text else ""))
    return "\n".join(out) or "no results"


def chunk_page(rows: DataFrame, with_content: bool = True) -> str:
    got = [r.asDict() for r in rows.collect()]
    body = "\n\n".join(f"## {r['symbol_name']} ({r['symbol_kind']}) {r['relative_path']}:{r['start_line']}-{r['end_line']}" + (f"\n{r['content']}" if with_content else "") for r in got)
    return body + ("\n\nmore: raise the offset" if got and got[0].get("has_more") else "") if got else "no chunks"


def grouped_lines(rows: DataFrame) -> str:
    out, last = [], None
    for r in rows.orderBy("path", "line_number").collect():
        if r.path != last:
            out.append(r.path)
            last = r.path
        out.append(f"  {r.line_number}: {r.line}")
    return "\n".join(out)


def status(row: DataFrame) -> str:
    return json.dumps(row.first().asDict(recursive=True), indent=2, default=str)


def context(c) -> str:
    return "\n\n".join(f"# {title} ({tokens} tokens)\n{text}" for title, text, tokens in c.sections) + ("\n\n(truncated)" if c.truncated else "")
