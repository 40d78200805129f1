"""Python sources as normalised trees: names and literals lose their spelling, operators keep theirs."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

MAX_DEPTH, IDENT, LITERAL = 500, "__ident__", "__literal__"


class Node(NamedTuple):
    kind: str
    start: int
    end: int
    nodes: int
    hash: str
    depth: int
    boilerplate: bool


def kind(node: ast.AST) -> str:
    if isinstance(node, ast.Name | ast.arg | ast.alias):
        return IDENT
    if isinstance(node, ast.Constant):
        return LITERAL
    if isinstance(node, ast.operator | ast.unaryop | ast.boolop | ast.cmpop):
        return "__op__" + type(node).__name__
    return type(node).__name__


def boilerplate(node: ast.AST) -> bool:
    """Imports, a module's docstring line, and the guard at its end."""
    if isinstance(node, ast.Import | ast.ImportFrom):
        return True
    return isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and isinstance(node.test.left, ast.Name) and node.test.left.id == "__name__"


def tree(source: str) -> list[Node]:
    """Every node in pre-order with its Merkle hash; raises on what does not parse or lies too deep."""
    starts = [0]
    for line in source.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    made: list[Node] = []

    def walk(node: ast.AST, depth: int, inherited: bool, span: tuple[int, int]) -> tuple[str, int]:
        if depth > MAX_DEPTH:
            raise RecursionError("the tree is too deep")
        if hasattr(node, "lineno"):
            span = starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset
        own, at = inherited or boilerplate(node), len(made)
        made.append(None)  # type: ignore[arg-type]
        below = [walk(c, depth + 1, own, span) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context)]
        name = kind(node)
        digest = hashlib.sha256(b"\0".join([name.encode(), *(h.encode() for h, _ in below)])).hexdigest()
        count = 1 + sum(n for _, n in below)
        made[at] = Node(name, *span, count, digest, depth, own)
        return digest, count

    walk(ast.parse(source), 0, False, (0, len(source.encode())))
    return made


def fingerprints(files: DataFrame, min_nodes: int) -> DataFrame:
    """(file_id, text) -> a row for each subtree of `min_nodes` or more that is no boilerplate; files that don't parse give a row with `skipped`."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, text in zip(batch["file_id"], batch["text"], strict=True):
                try:
                    rows += [(file_id, n.kind, n.start, n.end, n.nodes, n.hash, None) for n in tree(text or "") if n.nodes >= min_nodes and not n.boilerplate and n.depth]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((file_id, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["file_id", "kind", "start", "end", "nodes", "hash", "skipped"]).astype({c: "Int64" for c in ("file_id", "start", "end", "nodes")})

    return files.select("file_id", "text").mapInPandas(make, "file_id long, kind string, start long, end long, nodes long, hash string, skipped string")
