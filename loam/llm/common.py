"""Helpers shared by the corpus operators: shared-storage tables, text columns,
and word splitting that agrees with the tokenizers library."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + _own_folder()


@functools.lru_cache(1)
def _own_folder() -> str:
    """This process's folder, deleted when it ends."""
    path = tempfile.mkdtemp(prefix="loam-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


#: Tables that this process has stashed and not deleted yet.
_STASHED: dict[str, SparkSession] = {}


class Tables(list):
    """Paths of the tables that were stashed within a ``scope``."""

    def release(self, *keep: DataFrame) -> None:
        """Delete those that are still there, but for ``keep``."""
        kept = {df.stash_path for df in keep}
        for path in self:
            if path in _STASHED and path not in kept:
                _delete(_STASHED[path], path)


_SCOPE: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scope():
    """Collects the tables stashed within, so that one run can delete its own and no others."""
    own = Tables()
    token = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(token)


@atexit.register
def _delete_all() -> None:
    """What is left when the process ends: no result can read it any more."""
    with contextlib.suppress(Exception):
        for path, spark in list(_STASHED.items()):
            _delete(spark, path)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there,
    and a lost executor loses none of it. ``df.stash_path`` of the result names the folder.
    Tables that a result still reads stay until their ``scope`` or ``release`` deletes them, or the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    _STASHED[path] = spark
    if (own := _SCOPE.get()) is not None:
        own.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STASHED.pop(path, None)


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.stash_path)


def release(*keep: DataFrame) -> None:
    """Delete all of the process's stashed tables but those of ``keep``: once every result that reads one is written."""
    kept = {df.stash_path for df in keep}
    for path, spark in list(_STASHED.items()):
        if path not in kept:
            _delete(spark, path)


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null: empty) alone, so other columns can't clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


#: A key with over one in so many of the rows is hot; there are at most so many hot keys.
HOT_SHARE = 10_000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, least: int = 1000) -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key, on ``keys``: whatever share a key has.

    ``count`` is a column of ``table``: at least as many ``rows`` as have the key; the counts add up to
    ``total`` at most. Keys with over ``total / HOT_SHARE`` (and over ``least``) of them are thus
    at most ``HOT_SHARE``: a bounded table, which is broadcast. All others meet by shuffle, none of
    them with more rows than that. Both inputs are read twice, so they should be stashed.
    """
    limit = max(least, total // HOT_SHARE)
    hot = table.filter(F.col(count) > limit)
    if total <= limit or hot.isEmpty():
        return rows.join(table, keys)
    few = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col(count) <= limit), keys)
    return few.unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or what no column of ``df`` is called yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def slices(column, size: int = 512):
    """An Arrow column's values as Python lists of bounded length; memory that Arrow has freed goes back."""
    import pyarrow as pa

    for a in range(0, len(column), size):
        yield column.slice(a, size).to_pylist()
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """What this process has freed goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidy(run):
    """``run``, for mapInArrow: at its end the task gives back what it has freed. Executors keep Python workers
    for later tasks, and what an idle one holds on to lessens what the next stage may use."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


class WordTable(dict):
    """Distinct-word table of one task: a word's value is made once and kept.

    Bounded: with more than ``limit`` words the table becomes the older generation, from
    which words in use are taken over, and a new one begins.
    """

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
