"""What the operators of this subpackage share: the shared folder, written tables, text batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step inside a Python worker handles at once.
STEP_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent on one machine, a temporary folder takes its place; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="chronolake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/chronolake-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like a checkpoint: a lost executor costs a reread, never a recomputation,
    and a value computed once is the same for every reader.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def luck(*columns: Column | str) -> Column:
    """A number from 0 up to 1 made of the columns' hash: rows below a share are a sample of about that share."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder through the file system that its address names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def steps(texts: list, limit: int = STEP_CHARS) -> Iterator[list]:
    """Cut a list of texts into runs of bounded size; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if run and size + n > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def slices(column: pa.Array, limit: int = STEP_CHARS) -> Iterator[list]:
    """The texts of an Arrow column in runs of at most ``limit`` bytes, a longer text a run of its own; only one run at a time is a list."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield column.slice(at, to - at).to_pylist()
        at = to


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on between tasks, and an executor's memory is the sum of theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


_kept: dict[tuple, object] = {}


def kept(make: Callable, *args) -> object:
    """``make(*args)``, which the worker keeps from task to task until something else is asked for or :func:`forget` is called."""
    key = (make, *args)
    if key not in _kept:
        forget()
        _kept[key] = make(*args)
    return _kept[key]


def forget() -> None:
    """Let go of what is :func:`kept`: a worker lives through many stages, and another operator needs its memory."""
    if _kept:
        _kept.clear()
        gc.collect()
        give_back()


def text_struct(column: Column | str, schema: str, start: Callable[[], Callable[[list], dict]]) -> Column:
    """A struct column made from a text column by a vectorised Python function.

    ``start`` runs once in each worker and returns the function, which gets a list of texts (nulls
    included) and returns a dict of equally long lists. Only the text travels to Python. The column
    counts as non-deterministic, so that a later filter can't make Spark evaluate it twice. What
    another operator has :func:`kept` in the worker goes first.
    """

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        function = start()
        for s in batches:
            texts = s.tolist()
            del s
            parts = [pd.DataFrame(function(run)) for run in steps(texts)]
            del texts
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(function([]))
            del parts
            give_back()

    return apply.asNondeterministic()(column if isinstance(column, Column) else F.col(column))
