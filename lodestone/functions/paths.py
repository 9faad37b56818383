"""Path filters: scope, directories that never count, globs, extensions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories left out of searches.
EXCLUDED = ("node_modules", "bin", "obj", "dist", ".git", "packages", ".vs", ".vscode", "publish")


def normal_scope(scope: str | None) -> str:
    s = (scope or "").replace("\\", "/")
    while s.startswith("./"):
        s = s[2:]
    s = s.strip("/").lower()
    return "" if s == "." else s


def in_scope(path: Column, scope: str | None) -> Column:
    s = normal_scope(scope)
    return (F.lower(path) == s) | F.lower(path).startswith(s + "/") if s else F.lit(True)


def not_excluded(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return ~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED)))


def glob_regex(glob: str) -> str:
    """Of a whole path if the glob has a slash, else of a file name. `**` crosses directories, `*` and `?` don't; a slash after `**` stays a
    slash, so `a/**/b` is not `a/b`."""
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*|\*|\?)", glob.replace("\\", "/"))
    return "(?i)^" + "".join(wild.get(x) or re.escape(x) for x in parts) + "$"


def included(path: Column, globs: list[str] | None) -> Column:
    """Any of the globs; `*` says nothing."""
    globs = [g for g in globs or [] if g != "*"]
    if not globs:
        return F.lit(True)
    found = F.lit(False)
    name = F.substring_index(path, "/", -1)
    for g in globs:
        suffix = g[1:]
        if g.startswith("*") and not re.search(r"[*?/\\]", suffix):
            found = found | F.lower(path).endswith(suffix.lower())
        else:
            found = found | (path if "/" in g.replace("\\", "/") else name).rlike(glob_regex(g))
    return found


def accepted(path: Column, scope: str | None = None, globs: list[str] | None = None) -> Column:
    return in_scope(path, scope) & not_excluded(path) & included(path, globs)


def extension(path: Column) -> Column:
    """From the last dot of the file name; names that start with their only dot have none."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^.+?(\.[^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """All directories above a path, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def worktree_key(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+$", ""), r"[:\\/]", "_")
