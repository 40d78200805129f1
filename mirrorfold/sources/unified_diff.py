"""Unified diffs: strict hunks, their added and context lines, and whether a corpus agrees with them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class DiffError(ValueError):
    pass


class Line(NamedTuple):
    path: str
    line: int
    added: bool
    text: str


def parse(diff: str) -> list[Line]:
    """The new side's lines. Lines end with a newline alone, so a carriage return stays in the text."""
    made: list[Line] = []
    path, old, new, at = None, 0, 0, 0
    for row in diff.split("\n"):
        if old or new:
            kind, text = row[:1], row[1:]
            if kind == "\\":
                continue
            if kind not in (" ", "+", "-") and row:
                raise DiffError(f"a hunk of {path} ends early: {row[:40]!r}")
            old, new = old - (kind != "+"), new - (kind != "-")
            if old < 0 or new < 0:
                raise DiffError(f"a hunk of {path} is longer than it says")
            if kind != "-":
                if path is not None:
                    made.append(Line(path, at, kind == "+", text))
                at += 1
        elif row.startswith("+++ "):
            name = row[4:].split("\t")[0].rstrip("\r")
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif row.startswith("@@"):
            m = HUNK.match(row)
            if not m:
                raise DiffError(f"no hunk header: {row[:40]!r}")
            old, at, new = int(m[2] or 1), int(m[3]), int(m[4] or 1)
        elif row[:1] in ("+", " ") or row.startswith("-") and not row.startswith("--- "):
            raise DiffError(f"a line of {path} stands outside its hunk: {row[:40]!r}")
    if old or new:
        raise DiffError(f"a hunk of {path} is shorter than it says")
    return made


def disagreements(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, line, text) of a diff that the corpus (path, text) does not hold at that place."""
    held = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "held")).select("path", (F.col("at") + 1).cast("long").alias("line"), "held")
    return lines.join(held, ["path", "line"], "left").where(~F.col("held").eqNullSafe(F.col("text"))).select("path", "line", "text", "held")
