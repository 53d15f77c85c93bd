"""Binary files in the shared folder, written and read from inside tasks.

A task writes under a name of its own and reports that name in its result row. Only files reported by
the attempt whose rows Spark kept are ever read, so retried or speculative attempts leave at most
unread files behind.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def create(folder: str, stem: str, suffix: str):
    """A new file of ``folder``: (its URI, an output stream)."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = _open(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path)


def write_bytes(folder: str, stem: str, suffix: str, data: bytes) -> str:
    uri, out = create(folder, stem, suffix)
    with out:
        out.write(data)
    return uri


def open_random(uri: str):
    """A seekable input file."""
    store, path = _open(uri)
    return store.open_input_file(path)


def one_row_a_task(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A short driver list (one row per file), one row in each task."""
    df = spark.createDataFrame(rows, schema)
    return df.coalesce(1).repartition(max(1, len(rows)))
