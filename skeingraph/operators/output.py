"""Output: table rows, JSON, trees and Mermaid graphs. Texts are made at the edge; trees have as many rows as the node cap lets through."""

from __future__ import annotations

import json
import os
import tempfile
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeingraph.functions.text import one_line

#: Exit codes of a command line.
SUCCESS, INVALID_ARGUMENTS, ANALYSIS_FAILURE, DATABASE_FAILURE, REQUIRE_SINGLE_FAILURE = 0, 2, 3, 4, 5


class RequireSingle(ValueError):
    """Not exactly one root."""


def exit_code(error: Exception | None) -> int:
    from skeingraph.operators.integrity import IntegrityError
    from skeingraph.sources.store import StoreError

    if error is None:
        return SUCCESS
    if isinstance(error, RequireSingle):
        return REQUIRE_SINGLE_FAILURE
    if isinstance(error, (StoreError, IntegrityError)):
        return DATABASE_FAILURE
    return INVALID_ARGUMENTS if isinstance(error, ValueError) else ANALYSIS_FAILURE


def single(roots: DataFrame):
    """The only row, or RequireSingle."""
    rows = roots.limit(2).collect()
    if len(rows) != 1:
        raise RequireSingle("no symbol matches" if not rows else "several symbols match")
    return rows[0]


def table_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One tab-separated `line` a row; tabs and line ends of values become spaces, nulls nothing."""
    return df.select(F.concat_ws("\t", *[F.coalesce(one_line(F.col(c).cast("string")), F.lit("")) for c in columns]).alias("line"))


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def json_rows(df: DataFrame) -> DataFrame:
    """One indented JSON object a row, names in camel case."""
    row = F.struct(*[F.col(c).alias(_camel(c)) for c in df.columns])
    return df.select(F.to_json(row, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


#: What a Mermaid label writes in place of a character; "&" first.
MERMAID = {"&": "&amp;", '"': "&quot;", "[": "&#91;", "]": "&#93;", "<": "&lt;", ">": "&gt;", "\r\n": "<br/>", "\r": "<br/>", "\n": "<br/>"}


def escape_mermaid(text: str, call_site: bool = False) -> str:
    for a, b in MERMAID.items():
        text = text.replace(a, b)
    return text.replace("|", "&#124;") if call_site else text


def _branch(depth: int) -> str:
    """What stands before a node of a text tree."""
    return "   " * (depth - 1) + "└─ " if depth else ""


def _ordered(root: int, edges: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Nodes with their depths, depth first along the spanning edges in the order given."""
    below = defaultdict(list)
    for caller, callee, spanning in edges:
        if spanning:
            below[callee].append(caller)
    out, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        out.append((node, depth))
        stack += [(c, depth + 1) for c in reversed(below[node])]
    return out


def tree_text(names: dict[int, str], root: int, edges: list[tuple[int, int, bool]], truncated: bool = False, sites: dict[tuple[int, int], list[str]] | None = None) -> str:
    """Depth first along the spanning edges (caller, callee, spanning) in the order given; the others follow under a heading. sites: texts of an edge's call sites, below its caller."""
    sites, parent = sites or {}, {a: b for a, b, spanning in edges if spanning}
    lines = []
    for node, depth in _ordered(root, edges):
        lines.append(_branch(depth) + one_line_text(names[node]))
        lines += ["   " * depth + one_line_text(t) for t in sites.get((node, parent.get(node)), [])] if depth else []
    lines += ["└─ <truncated>"] if truncated else []
    rest = []
    for a, b, spanning in edges:
        if not spanning:
            rest += [f"  {one_line_text(names[a])} -> {one_line_text(names[b])}", *["    " + one_line_text(t) for t in sites.get((a, b), [])]]
    return "\n".join(lines + (["Additional edges:", *rest] if rest else []))


def one_line_text(text: str) -> str:
    return text.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")


def mermaid(names: dict[int, str], edges: list[tuple[int, int, bool]], truncated: bool = False, sites: dict[tuple[int, int], list[str]] | None = None) -> str:
    """A flow chart of nodes and edges in the order given; an edge's call sites are its label."""
    lines = ["flowchart TD", *[f'    n{n}["{escape_mermaid(t)}"]' for n, t in names.items()]]
    for a, b, _ in edges:
        label = "<br/>".join(escape_mermaid(t, call_site=True) for t in (sites or {}).get((a, b), []))
        lines.append(f'    n{a} -->|"{label}"| n{b}' if label else f"    n{a} --> n{b}")
    return "\n".join(lines + (["    %% truncated"] if truncated else []))


def tree_json(profile: str, objects: dict[int, dict], depths: dict[int, int], root: int, edges: list[tuple[int, int, bool]], truncated: bool, sites: dict[tuple[int, int], list[dict]] | None = None) -> str:
    """A caller tree as one JSON object; objects: the symbols' objects by id; sites: the call sites' objects of an edge, where sources are shown."""
    found = [{"caller": a, "callee": b, **({"callSites": sites.get((a, b), [])} if sites is not None else {})} for a, b, _ in edges]
    nodes = [{"symbol": objects[n], "depth": depths[n]} for n in objects]
    return json.dumps({"profile": profile, "truncated": truncated, "root": objects[root], "nodes": nodes, "edges": found}, indent=2, ensure_ascii=False)


def path_line(names: list[str], truncated: bool = False) -> str:
    return " -> ".join(names + (["<truncated>"] if truncated else []))


def path_tree(names: list[str], truncated: bool = False) -> str:
    return "\n".join(_branch(i) + n for i, n in enumerate(names + (["<truncated>"] if truncated else [])))


def path_json(profile: str, root: dict, nodes: list[dict] | None, truncated: bool = False) -> str:
    """A next-hop path as one JSON object; nodes: None where there is no path."""
    return json.dumps({"profile": profile, "found": nodes is not None, "truncated": truncated, "root": root, "nodes": nodes or []}, indent=2, ensure_ascii=False)


def write_atomically(path: str, text: str, refuse: str | None = None) -> None:
    """The whole text or nothing: a temporary file beside `path` replaces it. `refuse`: a path that may not be overwritten."""
    if refuse and os.path.abspath(path) == os.path.abspath(refuse):
        raise ValueError("the output would replace the index")
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
