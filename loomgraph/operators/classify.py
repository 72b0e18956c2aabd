"""File-level predicates: type, secrets, ignore rules, corpus health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, paths, text


def is_noise_dir(part: Column) -> Column:
    hit = part.isin(fixed.SKIP_DIRS)
    for tail in fixed.SKIP_DIR_SUFFIXES:
        hit = hit | part.endswith(tail)
    return hit


def in_noise_dir(rel_path: Column | str) -> Column:
    return F.exists(paths.parents(rel_path), is_noise_dir)


def is_skipped_file(rel_path: Column | str) -> Column:
    name = paths.basename(rel_path)
    return name.isin(fixed.SKIP_FILES + fixed.IGNORE_FILES) | name.endswith(".lock")


def keyword_is_load_bearing(name: Column | str) -> Column:
    """A secret word names the contents when it ends the stem or the stem is short."""
    stem = F.substring_index(F.ltrim(text.as_col(name), F.lit(".")), ".", 1)
    words = F.size(F.filter(F.split(stem, r"(?U)[-_\s]+"), lambda w: w != ""))
    hit = F.lit(False)
    for pattern in fixed.SENSITIVE_KEYWORDS:
        ends = stem.rlike(f"(?i)(?:{pattern})\\z")
        hit = hit | ends | (stem.rlike(f"(?i){pattern}") & (words <= fixed.SHORT_STEM_WORDS))
    return hit


def is_sensitive(rel_path: Column | str) -> Column:
    name = paths.basename(rel_path)
    hit = F.exists(paths.parents(rel_path), lambda p: p.isin(fixed.SENSITIVE_DIRS))
    for pattern in fixed.SENSITIVE_NAME_PATTERNS:
        hit = hit | name.rlike(pattern)
    return hit | keyword_is_load_bearing(name)


def paper_signals(content: Column | str, patterns: list[str] | None = None) -> Column:
    return text.count_hits(text.as_col(content), patterns or fixed.PAPER_SIGNALS)


def looks_like_paper(content: Column | str, patterns: list[str] | None = None) -> Column:
    return F.coalesce(paper_signals(content, patterns), F.lit(0)) >= fixed.PAPER_SIGNAL_THRESHOLD


def markdown_is_paper(content: Column | str) -> Column:
    """The markdown extractor's variant: no arXiv-number signal, case ignored throughout."""
    return looks_like_paper(content, [f"(?i){p}" for p in fixed.PAPER_SIGNALS[:-1]])


def classify(path: Column | str, content: Column | str) -> Column:
    """code / paper / image / document, or null when the suffix says nothing."""
    ext = F.lower(paths.suffix(path))
    return (
        F.when(ext.isin(fixed.CODE_EXTENSIONS), "code")
        .when(ext.isin(fixed.PAPER_EXTENSIONS), "paper")
        .when(ext.isin(fixed.IMAGE_EXTENSIONS), "image")
        .when(ext.isin(fixed.DOC_EXTENSIONS), F.when(looks_like_paper(content), "paper").otherwise("document"))
    )


# --- ignore rules -----------------------------------------------------------


def parse_ignore_line(raw: Column | str) -> Column:
    """One ignore-file line; empty for blanks and comments."""
    line = F.regexp_replace(text.as_col(raw), r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace(line, r"(?U)\s+#+[^\\].*$", "")
    body = F.regexp_replace(F.replace(body, F.lit("\\#"), F.lit("#")), r"(?<!\\) +$", "")
    return F.when((line == "") | line.startswith("#"), "").otherwise(body)


def ignored(rel_path: Column | str, rules: list[str]) -> Column:
    """Last matching rule wins; ``!`` rules un-ignore.

    ``rules`` come from a few ignore files at the corpus root, so they are
    plan constants; each rule overrides the verdict of those before it.
    """
    rel = text.as_col(rel_path)
    parts = paths.components(rel)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    candidates = F.concat(parts, prefixes)
    verdict = F.lit(False)
    for rule in rules:
        negated = rule.startswith("!")
        glob = (rule[1:] if negated else rule).strip("/")
        if not glob:
            continue
        verdict = F.when(_any_matches(candidates, paths.glob_regex(glob)), F.lit(not negated)).otherwise(verdict)
    return verdict


def _any_matches(candidates: Column, regex: str) -> Column:
    return F.exists(candidates, lambda c: c.rlike(regex))


# --- corpus summaries ----------------------------------------------------------


def corpus_health(files: DataFrame) -> DataFrame:
    """One row: file and word totals plus the size warning.

    ``files`` carries ``file_type`` and ``words``; unclassified rows are out.
    """
    kept = files.where(F.col("file_type").isNotNull())
    words = F.when(F.col("file_type").isin("document", "paper"), F.col("words"))
    totals = kept.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("total_words"),
    )
    small = (F.col("total_words") < fixed.SMALL_CORPUS_WORDS) & (F.col("total_files") <= fixed.SMALL_CORPUS_FILES)
    return totals.withColumn(
        "warning",
        F.when(F.col("total_files") == 0, fixed.WARN_EMPTY).when(small, fixed.WARN_SMALL),
    )


def bucket_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(F.count("*").alias("n_files"))
