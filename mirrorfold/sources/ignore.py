"""Ignore rules of a tree: patterns as regular expressions, the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern[str]
    keep: bool  # a negated rule
    folders: bool  # for folders alone


def expression(glob: str) -> str:
    """A glob's regular expression: * and ? stay within a component, ** crosses them."""
    out, at = "", 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + ".*", at + 2
        elif c == "[" and (end := glob.find("]", at + 2)) > 0:
            body = glob[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
    return out


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file that stands in the folder `base`."""
    made = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:].removeprefix("\\")
        folders, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        prefix = re.escape(base.rstrip("/") + "/") if base else ""
        made.append(Rule(re.compile(prefix + ("" if rooted else "(?:.*/)?") + expression(line.lstrip("/")) + r"\Z", re.S), keep, folders))
    return made


def ignored(path: str, found: list[Rule], folder: bool = False) -> bool:
    """Whether a path below the root is out; what lies in an ignored folder stays out whatever follows."""
    parts = path.strip("/").split("/")
    for n in range(1, len(parts) + 1):
        is_folder, verdict = folder or n < len(parts), False
        for rule in found:
            if (is_folder or not rule.folders) and rule.pattern.match("/".join(parts[:n])):
                verdict = not rule.keep
        if verdict:
            return True
    return False
