"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.storage import checkpoint, join_small, new_path, shared_dir  # noqa: F401

def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def release_memory() -> None:
    """Give back what a task has taken: its Python worker lives on and serves other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, out of batches of rows that are sorted by the keys."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        columns = [rows[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        ends = [0, *cuts.tolist(), len(rows)]
        for start, end in zip(ends[:-2], ends[1:-1]):
            yield rows.iloc[start:end]
        rest = rows.iloc[ends[-2] :]
    if rest is not None:
        yield rest
