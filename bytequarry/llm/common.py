"""What the corpus operators share: inputs, the shared scratch folder, written tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch that goes to a Python worker: whole texts, so far fewer than Spark's default.
BATCH_ROWS = 1000

#: Folders of the applications that wrote here, by application id.
_folders: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Let the session send at most BATCH_ROWS rows at once to a Python worker, unless it has a size of its own.

    The queries and the pipeline call this, since it bounds what a worker holds of a table of whole texts;
    the operators do not, and leave every setting of their caller's session alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *used: list[str]) -> str:
    """The name with as many underscores before it as it takes to clash with none of the columns in use."""
    taken = {c.lower() for columns in used for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder that the session names in spark.checkpoint.dir.

    Only a local session may leave that unset, and gets a temporary folder: executors on other machines would
    not see one. What an application wrote goes when its driver ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="bytequarry-")
        folder = f"{base.rstrip('/')}/bytequarry/{app}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
        _folders[app] = folder
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: computed once, with no lineage to lose."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_file(path: str, mode: str):
    """A file of the shared folder, whatever store it is in: "r" to read, "w" to write (its folder is made)."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    if mode == "r":
        return store.open_input_file(at)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at)


def put_file(path: str, data) -> None:
    """Write a whole file under a name of the attempt's own and move it; an earlier attempt's file of the same content stays."""
    from pyarrow import fs

    part = f"{path}.{uuid.uuid4().hex}.part"
    with open_file(part, "w") as out:
        out.write(data)
    store, at = fs.FileSystem.from_uri(path)
    _, part = fs.FileSystem.from_uri(part)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        store.move(part, at)
    else:
        store.delete_file(part)


def remove_folder(path: str) -> None:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.delete_dir(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives the memory that it no longer holds back to the system.

    Workers stay for later tasks, those of other stages too, and what the allocators keep of a task's largest batches
    would add up beside the JVM's heap.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trim() -> None:
    """Give free memory back to the system, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # glibc has it; other C libraries go without
    if (free := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        free(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over every Arrow batch; a batch may give None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(given_back(run), schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary() if batch.schema.field(name).type == pa.string() else pa.large_binary()).to_pylist()]


def id_buckets(df: DataFrame, n: int, id_col: str = "doc_id", tie: str | None = None) -> tuple[Column, int]:
    """The bucket (0 to count-1, ascending with the id, null first) of each row, and the count of buckets.

    Bounds are quantiles of the ids, so buckets hold about as many rows each. An id that holds more than a
    bucket's share of the rows, or null, has several buckets if `tie` names a column of evenly spread 64-bit
    hashes: they ascend with it. Only the bounds, at most n - 1 of them, come to the driver.
    """
    at = F.col(id_col)
    found = df.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("b"), F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
    bounds = (found["b"] or []) if n > 1 else []
    edges = sorted(set(bounds))
    # so many buckets for null, for the ids below the first edge (1), and for those from each edge on
    nulls = max(1, round(n * (found["n"] - found["ids"]) / max(found["n"], 1))) if tie and found["n"] > found["ids"] else 0
    each = [len([b for b in bounds if b == e]) if tie else 1 for e in edges]
    first = [nulls + 1 + sum(each[:i]) for i in range(len(edges))]
    count = nulls + 1 + sum(each)

    def part(of: Column | int) -> Column:
        """Which of so many equal parts of the hashes' range a row's tie is in."""
        share = (F.col(tie).cast("double") + 2.0**63) / 2.0**64 if tie else F.lit(0.0)
        return F.least(F.floor(share * of), F.lit(of) - 1 if isinstance(of, int) else of - 1).cast("int")

    bucket = F.lit(nulls)
    if edges:
        steps, values = [1 << k for k in reversed(range(len(edges).bit_length()))], F.lit(edges)
        k = F.aggregate(
            F.array(*[F.lit(x) for x in steps]), F.lit(0),
            lambda low, step: F.when((low + step <= len(edges)) & (F.get(values, low + step - 1) <= at), low + step).otherwise(low),
        )
        own = F.transform(F.array(k), lambda k: F.when(k == 0, nulls).otherwise(F.get(F.lit(first), k - 1) + F.when(at == F.get(values, k - 1), part(F.greatest(F.lit(1), F.get(F.lit(each), k - 1) - 1))).otherwise(F.get(F.lit(each), k - 1) - 1)))
        bucket = own[0]
    return F.when(at.isNull(), part(nulls) if nulls else 0).otherwise(bucket).cast("int"), count
