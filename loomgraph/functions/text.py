"""Text expressions. Each is a Column -> Column function that stays in the JVM
unless the value needs Unicode folding Spark has no expression for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import fixed

# Characters for which NFC, NFKC and casefold agree with lower(): ASCII and the
# Latin-1 letters except sharp s. Everything else goes through the Arrow UDFs.
_PLAIN = r"^[\x00-\x7F\u00C0-\u00DE\u00E0-\u00FF]*$"
_SPACE = r"[\s\x1c-\x1f]"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def _fold_nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def folded_id(x: str) -> str:
    """``id_form`` of a Python string."""
    return re.sub(r"(?:[^\w]|_)+", "_", unicodedata.normalize("NFKC", x)).strip("_").casefold()


@F.pandas_udf(T.StringType())
def _fold_id(s: pd.Series) -> pd.Series:
    return s.map(folded_id, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_words(s: pd.Series) -> pd.Series:
    return s.map(lambda x: re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x).casefold()).strip(), na_action="ignore")


def _routed(col: Column, native: Column, folded) -> Column:
    """``native`` where the text is plain, otherwise ``folded(col)``.

    The UDF is handed nulls for plain rows, so only text that needs folding
    pays for it.
    """
    plain = col.rlike(_PLAIN)
    return F.when(plain, native).otherwise(folded(F.when(~plain, col)))


def query_norm(label: Column | str, plain: bool = False) -> Column:
    """Lookup form of a label: NFC then casefold."""
    col = as_col(label)
    return F.lower(col) if plain else _routed(col, F.lower(col), _fold_nfc)


def strip_call(col: Column) -> Column:
    """Drop one trailing ``()``."""
    return F.when(F.contains(col, F.lit("()")), F.regexp_replace(col, r"\(\)$", "")).otherwise(col)


def bare(label: Column | str, plain: bool = False) -> Column:
    return strip_call(query_norm(label, plain))


def callable_key(label: Column | str) -> Column:
    """Key on which a call site meets a definition: ``  .Foo()`` -> ``foo``."""
    col = as_col(label)
    visible = F.left(col, F.lit(1)).between("!", "~") & F.right(col, F.lit(1)).between("!", "~")  # nothing to strip
    col = F.when(visible, col).otherwise(F.regexp_replace(col, rf"(?U)^{_SPACE}+|{_SPACE}+$", ""))
    return F.lower(F.ltrim(F.btrim(col, F.lit("()")), F.lit(".")))


def merge_norm(label: Column | str, plain: bool = False) -> Column:
    """Comparison form for near-duplicate labels: NFKC, casefold, words only."""
    col = as_col(label)
    native = F.btrim(F.regexp_replace(F.lower(col), r"(?U)[\W_]+", " "))
    return native if plain else _routed(col, native, _fold_words)


def id_form(value: Column | str, plain: bool = False) -> Column:
    """Identifier form: NFKC, non-word runs to one underscore, trimmed, casefolded."""
    col = as_col(value)
    native = F.lower(F.btrim(F.regexp_replace(col, r"(?U)(?:[^\w]|_)+", "_"), F.lit("_")))
    return native if plain else _routed(col, native, _fold_id)


def sanitize_label(label: Column | str) -> Column:
    col = F.regexp_replace(F.coalesce(as_col(label), F.lit("")), r"[\x00-\x1f\x7f]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def sanitize_metadata(metadata: Column | str) -> Column:
    """Sanitize every value of a string map."""
    return F.transform_values(as_col(metadata), lambda _, v: sanitize_label(v))


def file_type(raw: Column | str) -> Column:
    """Fold free-form type names into the closed domain, default ``concept``."""
    key = F.lower(F.regexp_replace(as_col(raw), rf"(?U)^{_SPACE}+|{_SPACE}+$", ""))
    table = F.create_map(*[F.lit(x) for kv in fixed.FILE_TYPE_SYNONYMS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit("concept"))


def title_label(node_id: Column | str) -> Column:
    """Human label for an id: every run of letters capitalised."""
    spaced = F.btrim(F.replace(as_col(node_id), F.lit("_"), F.lit(" ")))
    # initcap starts words at blanks only, so mark letter runs that begin elsewhere
    marked = F.regexp_replace(spaced, r"([^\p{L}\s])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def question_tokens(question: Column | str) -> Column:
    """Search terms of a question, in order, repeats kept."""
    words = F.regexp_extract_all(as_col(question), F.lit(r"[a-zA-Z_][a-zA-Z0-9_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in fixed.QUESTION_STOP_WORDS])
    return F.filter(F.transform(words, F.lower), lambda w: ~F.array_contains(stop, w))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(as_col(text), F.lit(r"(?U)[^\s\x1c-\x1f]+")).cast("long")


def clip_tokens(text: Column | str, tokens: int) -> Column:
    return F.left(as_col(text), F.lit(tokens * fixed.CHARS_PER_TOKEN))


def short_label(label: Column | str, width: int = 22) -> Column:
    """Label for a drawing: at most ``width`` characters, ellipsis when cut."""
    col = as_col(label)
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width - 1)), F.lit("\u2026"))).otherwise(col)


def clamp_score(raw: Column | str) -> Column:
    """A score in [0, 1]; anything that is not a number counts as the default."""
    score = F.coalesce(as_col(raw).try_cast("double"), F.lit(fixed.DEFAULT_EDGE_SCORE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def count_hits(text: Column, patterns: list[str]) -> Column:
    """How many of ``patterns`` occur in ``text``."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))
