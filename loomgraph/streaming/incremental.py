"""Keyed state for incremental rebuilds: the latest known version of every path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "path string, hash string, version long, status string"
STATE = "hash string, version long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Report a path when its newest content differs from what is stored.

    Rows older than the stored version are late copies and are skipped. Only
    the newest row of each batch is kept, so memory stays flat however often a
    path repeats.
    """
    stored_hash, stored_version = state.get if state.exists else (None, None)
    best_hash, best_version = stored_hash, stored_version
    for pdf in batches:
        top = pdf.loc[pdf["version"].idxmax()]
        if best_version is None or top["version"] > best_version:
            best_hash, best_version = top["hash"], int(top["version"])
    if best_version != stored_version:
        state.update((best_hash, best_version))
        if best_hash != stored_hash:
            status = "added" if stored_version is None else "changed"
            yield pd.DataFrame({"path": [key[0]], "hash": [best_hash], "version": [best_version], "status": [status]})


def changed_paths(versions: DataFrame) -> DataFrame:
    """Stream of (path, hash, version) -> stream of paths to extract again."""
    return versions.groupBy("path").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
