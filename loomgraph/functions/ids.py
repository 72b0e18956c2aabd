"""Canonical identity. Every producer builds ids here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import paths, text


def normalize_id(value: Column | str, plain: bool = False) -> Column:
    """NFKC, non-word runs to one underscore, trimmed, casefolded.

    ``plain=True`` promises ASCII/Latin-1 input and keeps the expression free
    of Python.
    """
    return text.id_form(value, plain)


def joined(*parts: Column | str) -> Column:
    """The parts of a name before normalisation; empty parts vanish."""
    cols = [text.as_col(p).cast("string") for p in parts]
    kept = F.filter(F.array(*cols), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.transform(kept, lambda p: F.btrim(p, F.lit("_."))), "_")


def make_id(*parts: Column | str, plain: bool = False) -> Column:
    """Id of an entity named by several parts."""
    return normalize_id(joined(*parts), plain)


def code_file_id(path: Column | str, plain: bool = False) -> Column:
    """Code files are named by parent folder and stem."""
    col = text.as_col(path)
    return make_id(paths.parent_name(col), paths.stem(col), plain=plain)


def document_id(path: Column | str, plain: bool = False) -> Column:
    return make_id(paths.basename(text.as_col(path)), plain=plain)


def module_id(name: Column | str, plain: bool = False) -> Column:
    return make_id(F.lit("mod"), name, plain=plain)


def package_id(name: Column | str, plain: bool = False) -> Column:
    return make_id(F.lit("pkg"), name, plain=plain)


def concept_id(name: Column | str, plain: bool = False) -> Column:
    return make_id(F.lit("concept"), name, plain=plain)


def concept_name(name: str | None) -> str:
    """``concept_id`` of a Python string."""
    if name and name.isascii() and name.isalnum():
        return f"concept_{name.lower()}"
    return text.folded_id(f"concept_{name.strip('_.')}" if name else "concept")


def fragment_id(name: Column | str, content: Column | str) -> Column:
    return F.concat_ws(":", text.as_col(name), F.left(F.sha2(text.as_col(content), 256), F.lit(16)))


def module_stem(name: Column | str) -> Column:
    return F.substring_index(F.btrim(F.coalesce(text.as_col(name), F.lit("")), F.lit(".")), ".", -1)


def same_id(a: str, b: str) -> Column:
    """Two id columns are equal: for joins, whose rows are then sorted by a number first, as ids begin alike and sort slowly."""
    return (F.xxhash64(a) == F.xxhash64(b)) & (F.col(a) == F.col(b))
