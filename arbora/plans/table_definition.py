"""Saved table definitions: column-by-column tables compiled to a select.

A definition is a list of columns, JSON or dicts:

    [{"class": "customer", "condition": "c_acctbal > 100"},
     {"from": 1, "tag": "nation", "need": "mandatory", "title": "Nation"},
     {"from": 1, "tag": "orders", "show": "count"}]

need: optional (outer), mandatory (inner) or null (rows without a value). show: value,
count, min, max, sum, average, stddev or multi. `%1`, `%2` … in a condition are earlier
columns; other `%name` are parameters.
"""

from __future__ import annotations

import json
import re

SHOW = {"count": "count", "min": "min", "max": "max", "sum": "sum", "average": "average", "avg": "average", "stddev": "stddev"}


def compile_columns(columns: list[dict] | str, order: str | None = None, **params) -> str:
    """The text of the select that makes the table."""
    columns = json.loads(columns) if isinstance(columns, str) else columns
    steps, shown, titles = [], [], []
    for i, c in enumerate(columns, 1):
        v = f"x{i}"
        need = c.get("need", "optional")
        if "class" in c:
            step = f"{v} in class \"{c['class']}\""
        elif "compute" in c:
            step = f"{v} = {_columns(c['compute'])}"
        elif "right" in c:
            step = f"{v} in x{c['from']}[{c['right']}]"
        else:
            show = c.get("show", "value")
            path = f"x{c['from']}->{c['tag']}" + (f"[{c['column']}]" if c.get("column", 1) > 1 else "")
            step = f"{v} = {SHOW[show]} {path}" if show in SHOW else f"{v} in x{c['from']}=>{c['tag']}" if show == "multi" else f"{v} in {path}"
        conds = []
        if c.get("condition"):
            conds.append(f"({_condition(c['condition'], v, params)})")
        if need == "mandatory":
            conds.append(v)
        elif need == "null":
            conds.append(f"! {v}")
        steps.append(step + (" where " + " && ".join(conds) if conds else ""))
        if not c.get("hidden"):
            shown.append(v)
        if c.get("title"):
            titles.append(f"{v}:{c['title']}")
    text = f"select {', '.join(shown)} from {', '.join(steps)}"
    if order:
        text += f" order_by {order}"
    if titles:
        text += " TITLE " + ", ".join(titles)
    return text


def _columns(text: str) -> str:
    return re.sub(r"%(\d+)", r"x\1", text)


def _condition(text: str, v: str, params: dict) -> str:
    for k, x in params.items():
        text = text.replace(f"%{k}", str(x))
    text = _columns(text)
    # a condition that opens with a comparator is about the column itself
    return f"{v} {text}" if re.match(r"\s*(==|!=|[<>]=?|=~|~|like\b)", text) else re.sub(r"^\s*([A-Za-z_]\w*)(?=\s*(==|!=|[<>]=?|=~|~))", rf"{v}->\1", text)
