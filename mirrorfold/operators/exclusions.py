"""Which paths and texts take part, and which are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path components, suffixes and banners of the domain
DEPENDENCIES = ("node_modules", "vendor", ".cargo", ".pub-cache", ".venv")
ARTEFACTS = ("target", "dist", "build", "out", "coverage", ".vscode-test", "__pycache__", ".dart_tool", ".git", ".claude")
MINIFIED = (".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js", ".bundle.mjs", ".bundle.cjs")
HIDDEN = ("generated",)
HIDDEN_PAIRS = (("alembic", "versions"), ("test", "fixtures"), ("tests", "fixtures"))
HIDDEN_SUFFIXES = (
    ".g.cs", ".generated.cs", ".designer.cs", ".pb.cs", ".openapi.cs", ".generated.py", "_generated.py", ".g.dart", ".freezed.dart", ".gr.dart", ".config.dart", ".gen.dart",
    ".mocks.dart", ".pb.dart", ".pbenum.dart", ".pbjson.dart", ".pbserver.dart", ".pbgrpc.dart",
)
BANNERS = (
    "generated code - do not modify by hand", "auto generated file, do not edit.", "autogenerated by jnigen. do not edit!", "auto-generated file, do not modify!",
    "this file has been automatically generated. please do not edit it manually.", "do not edit. this is code generated via package:intl/generate_localized.dart",
    "generated code. do not modify.", "this is a generated file - do not edit.", "generated by the protocol buffer compiler. do not edit!",
    "generated by the grpc python protocol compiler plugin. do not edit!", "@generated", "this file is @generated by prost-build.",
)
FRAMED_BANNERS = (
    ("auto generated by jnigen", "do not edit!"), ("autogenerated from pigeon", "do not edit directly."), ("code generated ", "do not edit."), ("<auto-generated", ">"), ("<autogenerated", ">"),
    ("@generated by ", ""), ("@generated from ", ""), ("@generated signedsource<<", ""), ("automatically generated by rust-bindgen", ""), ("note: this class is auto generated by ", ""),
)
MEAN_LINE, LEAST_SIZE, SAMPLE = 200, 16_384, 65_536


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def parts(path: Column) -> Column:
    """The components of a path, lower-case, without empty ones and the directory itself."""
    return F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & (p != "."))


def excluded(path: Column, dependencies: bool = False) -> Column:
    """Below an artefact's folder, or a dependency's unless they are asked for; paths are relative to the scan's root."""
    names = ARTEFACTS if dependencies else ARTEFACTS + DEPENDENCIES
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, names)))


def minified(path: Column, text: Column) -> Column:
    """By its name, or large with long lines in its first SAMPLE bytes."""
    sample = F.substring(F.encode(text, "utf-8"), 1, SAMPLE)
    plain = F.decode(sample, "iso-8859-1")  # a character a byte
    mean = F.floor(F.length(plain) / (F.length(plain) - F.length(F.replace(plain, F.lit("\n"))) + 1))
    return any_of([F.endswith(F.lower(path), F.lit(s)) for s in MINIFIED]) | ((F.octet_length(text) >= LEAST_SIZE) & (mean > MEAN_LINE))


def report_hidden(path: Column) -> Column:
    """Generated code by its folder, by two folders in a row, or by its name."""
    p = parts(path)
    row = F.concat(F.lit("/"), F.array_join(p, "/"), F.lit("/"))
    pairs = [F.contains(row, F.lit(f"/{x}/{y}/")) for x, y in HIDDEN_PAIRS]
    name = F.try_element_at(p, F.lit(-1))
    return F.arrays_overlap(p, F.array(*map(F.lit, HIDDEN))) | any_of(pairs) | F.coalesce(any_of([F.endswith(name, F.lit(s)) for s in HIDDEN_SUFFIXES]), F.lit(False))


def contained(path: Column) -> Column:
    """A relative path that never leaves its root on the way."""
    p = F.split(path, "/")
    depth = F.aggregate(p, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: _step(a, F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)))
    return ~F.startswith(path, F.lit("/")) & (depth["low"] >= 0)


def _step(a: Column, by: Column) -> Column:
    return F.struct((a["at"] + by).alias("at"), F.least(a["low"], a["at"] + by).alias("low"))


def opening_comments(text: Column) -> Column:
    """The lines above the first that is neither blank nor a comment by its first sign."""
    lines = F.split(text, "\n", -1)
    code = F.array_position(F.transform(lines, lambda line: ~line.rlike(r"^[ \t\r]*([/*#!(]|$)")), True)
    return F.when(code == 0, lines).otherwise(F.slice(lines, 1, F.greatest(code.cast("int") - 1, F.lit(0))))


def comment_line(line: Column) -> Column:
    """As its author worded it: one run of comment signs and a block's end removed, white space runs as one space, lower-case."""
    worded = F.regexp_replace(F.regexp_replace(line, r"^[ \t\r]*[/*#!(]*[ \t\r]*", ""), r"[ \t\r]*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(worded, r"(\*/|\*\))$", ""), r"[ \t\r]+", " ")))


def generated(text: Column) -> Column:
    """A generator's banner is a whole line of the opening comments; a phrase in prose is none."""
    framed = lambda line: any_of([(F.length(line) >= len(a) + len(b)) & F.startswith(line, F.lit(a)) & F.endswith(line, F.lit(b)) for a, b in FRAMED_BANNERS])
    return F.exists(F.transform(opening_comments(text), comment_line), lambda line: line.isin(*BANNERS) | framed(line))
