"""Path expressions on ``/``-separated paths, with pathlib's meaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import as_col


def basename(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(as_col(path), F.lit("/")), "/", -1)


def components(path: Column | str) -> Column:
    return F.filter(F.split(as_col(path), "/"), lambda p: p != "")


def parents(path: Column | str) -> Column:
    """All components but the last."""
    parts = components(path)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def parent_name(path: Column | str) -> Column:
    parts = components(path)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2))


def suffix(path: Column | str) -> Column:
    """Last extension with its dot; empty for dotfiles and trailing dots."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = basename(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored Java regex; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close]
            negate = body.startswith("!")
            body = body[1:] if negate else body
            out.append("[" + ("^" if negate else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", ch, flags=re.ASCII))
        i += 1
    return "(?s)^" + "".join(out) + "$"
