"""What the operators share: the shared scratch folder, written tables, blocks of rows."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import put_on_path

__all__ = ["discard", "documents", "kept_for", "new_name", "put_on_path", "shared_dir", "text_blocks", "turn_to", "written"]

#: Rows are worked on in blocks of about this many bytes of text, so that a worker's memory
#: follows the block and not Arrow's batch.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=8)
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def _own_dir(spark: SparkSession) -> str:
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return _local_dir(spark.conf.get("spark.app.id", ""))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``.

    The cluster names that folder; only where it is unset and the session is local, as in tests, one is made.
    A cluster's session without it gets an error, as its executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    if "://" not in root:
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def new_name(df: DataFrame, name: str) -> str:
    """``name``, or the like that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What this worker keeps from one task for the next: for which work, and what gives it up.
_kept: list[tuple[str, Callable[[], None]]] = []
_work = ""


def kept_for(work: str, give_up: Callable[[], None]) -> None:
    """Names a memo of this worker that serves tasks of one kind only."""
    _kept.append((work, give_up))


def turn_to(work: str) -> None:
    """Gives up what this worker keeps for other work, so that a worker that goes from stage to stage holds the memos of one.

    Called at the start of a task; tasks of one kind find the memos of those before.
    """
    global _work
    if work == _work:
        return
    _work = work
    for other, give_up in _kept:
        if other != work:
            give_up()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what is freed unless asked
        trim(0)


def text_blocks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = BLOCK_BYTES, work: str = "texts") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches holding about ``size`` bytes of text each, with their texts (null: empty); a longer text is a block of its own.

    ``work`` names the memos that the task uses; the worker's others are given up.
    """
    turn_to(work)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= size or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, [t if t is not None else "" for t in part.column(text_at).to_pylist()]
                start, total = i + 1, 0
