"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.session import configure, materialise

__all__ = ["SPACE", "configure", "digest", "fresh", "join_small", "kept", "let", "materialise", "pieces", "read",
           "release", "replaced", "same", "ship", "short_shuffles", "sources_path", "words"]

#: Blank characters of the contracts; words are what lies between them. ``bytes.split()`` uses the same set.
SPACE = r"[\x20\x09-\x0D]"
#: A lookup table of at most this many rows is broadcast (a row is a key and a few numbers).
BROADCAST_ROWS = 100_000
SALTS = 64
ARROW_ROWS = 1000


def ship(name: str) -> None:
    """Send a module's functions to the workers by value: they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def kept(key: str, make: Callable[[], object]) -> object:
    """Build once per worker process. Functions arrive by value with each task, so module globals would not last.

    The first word of ``key`` is the operator; a worker that goes on to another one forgets what this one kept.
    """
    store = sys.modules.setdefault("netloom_worker_store", types.ModuleType("netloom_worker_store")).__dict__
    group = key.split()[0]
    if store.get("netloom group") != group:
        for old in [k for k in store if " " in k]:
            del store[old]
        store["netloom group"] = group
    if key not in store:
        store[key] = make()
    return store[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Texts are long: small batches bound the memory that a task and its worker hold at once.
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers
    return os.path.join(os.path.dirname(public_tokenizers.__file__), name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; a lambda would otherwise evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use in any spelling of upper and lower case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def same(column: Column) -> Column:
    """A never-null form of a key, in which null equals null and nothing else."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def join_small(big: DataFrame, small: DataFrame, key: str, bound: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Left join with a stored lookup table of one row per key: broadcast only if its counted rows are within ``bound``.

    Beyond it, a key may still hold a third of ``big``: both sides then meet on (key, salt).
    """
    if small.count() <= bound:
        return big.join(F.broadcast(small), key, "left")
    salt = fresh(big, "salt")
    spread = big.withColumn(salt, F.floor(F.rand(7) * salts).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, salt], "left").drop(salt)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterable[pa.RecordBatch]:
    """Cut Arrow batches so that one piece holds about ``limit`` bytes of ``column`` (or a single longer row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(column)
        sizes = [0 if n is None else n for n in pc.binary_length(values).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def release(stored: DataFrame) -> None:
    """Delete the table behind what ``materialise`` returned, once a later table has taken its place."""
    spark = stored.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a stored or counted table go with the end of its run, not with the driver's next garbage collection.

    Only for code that stores what it reads twice: a plan that runs again would have to shuffle again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replaced(df: DataFrame, **kinds: T.DataType) -> tuple[DataFrame, T.StructType]:
    """(df without columns of these names in any case, schema with them added), as ``withColumn`` would replace them."""
    rest = df.drop(*kinds)
    return rest, T.StructType([*rest.schema.fields, *[T.StructField(k, v) for k, v in kinds.items()]])
