"""Session helpers: local sessions for tests, the shared folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Paths of the tables that ``materialize`` wrote and ``release`` has not deleted.
_WRITTEN: list[str] = []


def local_session(cores: str | int = "*", app: str = "cohortlake", **conf) -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    parallelism = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session may fall back to a temporary folder; on a cluster a
    machine-local path would be lost with its executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlake-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder once and go on from the columnar copy.

    For large inputs of several passes: later scans read only the columns they
    need, and a lost executor costs a re-read, not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["_stored_at"] = path
    _WRITTEN.append(path)
    return table


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The table itself if ``materialize`` wrote it, else a written copy: for inputs that are read more than once."""
    return df if "_stored_at" in df.__dict__ else materialize(df, name)


# Plan nodes that cost no more to run again than a written copy costs to read.
_CHEAP = {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range", "Union", "OneRowRelation"}


def reread(df: DataFrame, name: str = "table") -> DataFrame:
    """As ``stored``, but plain scans with filters and columns are not copied."""
    if "_stored_at" in df.__dict__:
        return df
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    heads = {found[1] for line in lines if (found := re.match(r"[\s:+|-]*(\w+)", line))}
    return df if heads <= _CHEAP else materialize(df, name)


def _width(field: T.StructField) -> Column:
    """Bytes of a value in memory, about; long strings, arrays and nested values as long as they are."""
    kind, value = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)) * 8 + 32
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(value.cast("string")), F.lit(0)) + 64
    return F.lit(16)


def sized(df: DataFrame, name: str = "table") -> tuple[DataFrame, int, int]:
    """A written copy (or the table itself, if it is one) with its rows and bytes in memory, read from the copy.

    Not by ``DataFrame.observe``: a session that has observed anything cannot be serialised any more, and Spark's
    fitted models carry their session to the tasks.
    """
    df = stored(df, name)
    if "_bytes" not in df.__dict__:
        each = sum((_width(f) for f in df.schema.fields), F.lit(16)).cast("long")
        found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).first()
        df.__dict__["_rows"], df.__dict__["_bytes"] = int(found["rows"]), int(found["bytes"])
    return df, df.__dict__["_rows"], df.__dict__["_bytes"]


def written(since: int = 0) -> list[str]:
    """Paths of the tables this process has written and not released, from the ``since``-th on."""
    return _WRITTEN[since:]


def release(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Delete written tables that nothing reads any more, but that of ``keep``.

    For jobs of several steps: what a step wrote on its way is of no use once its result is written.
    """
    spared = keep.__dict__.get("_stored_at") if keep is not None else None
    for path in paths:
        if path != spared and path in _WRITTEN:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _WRITTEN.remove(path)


@contextmanager
def small_steps(spark: SparkSession):
    """For jobs of several ``materialize``d steps that never run a plan twice, with long rows for Python.

    Within, shuffle files go when the action that wrote them ends, not when the driver collects its garbage, and
    tasks hand rows to Python about 8 MB at a time.
    """
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions, the yardstick for splitting hot groups."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
