"""A folder as a DataFrame of files: scan, prune, classify, and the raw-file tools."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import fixed, paths, text
from loomgraph.operators import classify
from loomgraph.session import cut, spread


#: Bytes of file contents that a task hands on at a time.
READ_BYTES = 1 << 24

_ENTRY = "rel string, folder boolean, size long, mtime_ns long"


def _base(root: str) -> str:
    return root.rstrip("/") if "://" in root else f"file://{Path(root).resolve()}"


def _lister(base: str):
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            for rel in batch["rel"]:
                found = system.get_file_info(fs.FileSelector(f"{top}/{rel}" if rel else top))
                yield pd.DataFrame(
                    [(f"{rel}/{f.base_name}" if rel else f.base_name, f.type == fs.FileType.Directory, f.size or 0, f.mtime_ns or 0) for f in found],
                    columns=["rel", "folder", "size", "mtime_ns"],
                )

    return entries


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size, mtime_ns): every file below ``root``, contents unread.

    Folders are listed level by level, each level spread over the executors;
    noise folders are not entered. Names may begin with anything.
    """
    base = _base(root)
    plain = base.removeprefix("file://")
    level, found = spark.createDataFrame([("",)], "rel string"), None
    while not level.isEmpty():
        listed = cut(spread(level).mapInPandas(_lister(base), _ENTRY))
        own = listed.where(~F.col("folder")).select(F.concat(F.lit(f"{plain}/"), "rel").alias("path"), "rel", "size", "mtime_ns")
        found = own if found is None else found.unionByName(own)
        level = listed.where(F.col("folder") & ~classify.in_noise_dir(F.concat("rel", F.lit("/.")))).select("rel")
    return found


def read_contents(files: DataFrame, root: str, wanted: Column) -> DataFrame:
    """``files`` with the text of those that are ``wanted``, undecodable bytes dropped.

    Only paths move between tasks; a file is read where its text is used next.
    """
    base, columns = _base(root), files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = fs.FileSystem.from_uri(base)
        for batch in batches:
            texts, low, held = [], 0, 0
            for k, (rel, want) in enumerate(zip(batch["rel"], batch["_wanted"], strict=True)):
                text = None
                if want:
                    with system.open_input_stream(f"{top}/{rel}") as source:
                        text = source.read().decode("utf-8", "ignore")
                texts.append(text)
                held += len(text or "")
                if held >= READ_BYTES or k + 1 == len(batch):
                    yield batch.iloc[low : k + 1].drop(columns="_wanted").assign(content=texts)
                    texts, low, held = [], k + 1, 0

    schema = T.StructType([*files.schema.fields, T.StructField("content", T.StringType())])
    return spread(files.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))).select(*columns, "_wanted").mapInPandas(read, schema)


def ignore_rules(root: str, extra: list[str] | None = None) -> list[str]:
    """Rules of the ignore files from the repository top down to ``root``.

    A handful of lines next to the root, read on the driver and turned into
    plan constants. Ignore files below the root are not consulted.
    """
    here = Path(root).resolve()
    chain = [here, *here.parents]
    top = next((i for i, d in enumerate(chain) if any((d / m).exists() for m in fixed.VCS_MARKERS)), len(chain) - 1)
    lines: list[str] = []
    for folder in reversed(chain[: top + 1]):
        for name in fixed.IGNORE_FILES:
            file = folder / name
            if file.is_file():
                lines += file.read_text(encoding="utf-8", errors="ignore").splitlines()
    return [rule for rule in (_rule(line) for line in lines + list(extra or [])) if rule]


def _rule(raw: str) -> str:
    """Driver-side twin of ``classify.parse_ignore_line`` for the few lines of an ignore file."""
    import re

    line = raw.strip()
    if not line or line.startswith("#"):
        return ""
    body = re.sub(r"\s+#+[^\\].*$", "", line).replace("\\#", "#")
    return re.sub(r"(?<!\\) +$", "", body)


def candidates(spark: SparkSession, root: str, extra_excludes: list[str] | None = None) -> DataFrame:
    """Scanned files that names and ignore rules let through, with ``sensitive`` marked.

    An ignored folder takes everything below it along.
    """
    rules = ignore_rules(root, extra_excludes)
    kept = scan(spark, root).where(~classify.in_noise_dir("rel") & ~classify.is_skipped_file("rel"))
    if rules:
        kept = kept.where(~classify.ignored("rel", rules) & ~_below_ignored(F.col("rel"), rules))
    return kept.withColumn("sensitive", classify.is_sensitive("rel"))


def _below_ignored(rel: Column, rules: list[str]) -> Column:
    parts = paths.parents(rel)
    folders = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda n: n > 0), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return F.exists(folders, lambda folder: classify.ignored(folder, rules))


def is_manifest(rel: Column | str) -> Column:
    """Package manifests are read whatever their suffix."""
    return F.lower(paths.basename(rel)).isin(fixed.MANIFEST_NAMES)


def detect(spark: SparkSession, root: str, extra_excludes: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(path, rel, size, mtime_ns, status, file_type, content, words, hash).

    status is kept, sensitive or unclassified; contents are only read for
    files that survive the checks on their name. A file whose size and time are those in
    ``known`` (path, size, mtime_ns, hash, file_type, words, failed) is not opened: it
    keeps what was known of it, and its content is null.
    """
    files = candidates(spark, root, extra_excludes)
    by_name = classify.classify("rel", F.lit(""))
    wanted = by_name.isin("code", "document", "paper") | is_manifest("rel")
    if known is None:
        files = files.withColumn("_known", F.lit(None).cast("struct<hash:string,file_type:string,words:bigint>"))
    else:
        before = known.where("not failed").select("path", "size", "mtime_ns", F.struct("hash", "file_type", "words").alias("_known"))
        files = files.join(before, ["path", "size", "mtime_ns"], "left")
    old = F.col("_known").isNotNull()
    joined = read_contents(files, root, ~F.col("sensitive") & wanted & ~old)
    kind = F.when(~F.col("sensitive"), F.when(old, F.col("_known.file_type")).otherwise(classify.classify("rel", "content")))
    typed = joined.withColumn("file_type", kind)
    words = F.when(F.col("file_type").isin("document", "paper"), text.word_count("content")).otherwise(F.lit(0).cast("long"))
    return typed.select(
        "path", "rel", "size", "mtime_ns",
        F.when(F.col("sensitive"), "sensitive").when(F.col("file_type").isNull(), "unclassified").otherwise("kept").alias("status"),
        "file_type", "content",
        F.when(old, F.col("_known.words")).otherwise(words).alias("words"),
        F.coalesce(F.col("_known.hash"), F.sha2("content", 256)).alias("hash"),
    )


# --- raw-file tools: look at the files themselves, no graph -----------------------


def _visible(files: DataFrame) -> DataFrame:
    return files.where(~F.exists(paths.parents("rel"), lambda p: p.isin(fixed.RAW_IGNORE_DIRS)))


def list_files(files: DataFrame) -> DataFrame:
    """(rel, entry) of ``files(rel, size)`` in path order."""
    entry = F.concat("rel", F.lit(" ("), "size", F.lit("B)"))
    return _visible(files).select("rel", entry.alias("entry")).orderBy("rel")


def read_files(files: DataFrame) -> DataFrame:
    """(rel, content)."""
    return files.select("rel", "content")


def read_file(files: DataFrame, rel: str) -> DataFrame:
    """One file; only its own row is read."""
    return read_files(files.where(F.col("rel") == rel))


def grep_hits(files: DataFrame, pattern: str) -> DataFrame:
    """(rel, line, hit) for every line of every file that matches ``pattern``."""
    from loomgraph.operators.extract_markdown import LINE_BREAK

    lines = _visible(files).where(F.col("content").rlike(pattern)).select("rel", F.posexplode(F.split("content", LINE_BREAK)).alias("at", "text"))
    return lines.where(F.col("text").rlike(pattern)).select(
        "rel", (F.col("at") + 1).alias("line"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("hit")
    )


def grep(files: DataFrame, pattern: str) -> DataFrame:
    """All hits in path order."""
    return grep_hits(files, pattern).orderBy("rel", "line")
