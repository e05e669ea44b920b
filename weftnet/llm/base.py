"""What the operators of this folder share: staging, row keys, prefix sums.

Row identity. ``doc_id`` may be null or repeated. Operators that join back to
the text use the pair (``_did``, ``_th``): the id with null mapped to the
smallest long, and xxhash64 of the text with null read as empty. Fully equal
rows therefore behave as one document and all get its result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NULL_ID = -(2**63)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="weftnet-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage; the table is on shared storage, so it outlives executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` as (_did, _th, doc_id, _text)."""
    text = text_or_empty()
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("_did"),
        F.xxhash64(text).alias("_th"),
        F.col("doc_id"),
        text.alias("_text"),
    )


def give_back() -> None:
    """Return freed memory of this process to the system; Spark keeps idle Python workers, and they keep what they freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def driver_gives_back(spark: SparkSession) -> bool:
    """``give_back`` in the driver, for its Python and its JVM; False where the JVM has no such command.

    What the JVM's compilers and codecs have freed stays in the arenas of malloc otherwise, some more from job to job.
    """
    give_back()
    try:
        gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        call = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke"][0]
        given = gateway.new_array(jvm.java.lang.Object, 4)  # the last two stay null: no parameters
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # noqa: BLE001  another JVM, system or kind of session: memory isn't given back, results are the same
        return False
    return True


def executors_give_back(spark: SparkSession) -> bool:
    """A full collection in the executors' JVMs, after which these return the heap that they don't need; False where it can't be asked for.

    A heap grows with what a stage allocates and stays so, beside the buffers and Python workers of the next one. Tasks are
    dealt one a core, so each executor gets some; one that gets none keeps its memory, and results are the same.
    """
    try:
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).collect()  # a row a core
    except Exception:  # noqa: BLE001  another kind of session, or no reflection: memory isn't given back
        return False
    return True


#: Bytes from which an Arrow batch for a Python worker is closed; by default rows alone count, 10,000 of them.
ARROW_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session's queries hold about ``ARROW_BYTES``, or one row; JVM and worker each hold some at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving memory back when a task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def row_of(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that none clashes with an operator's own."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])


def columns_of(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` from the struct ``row`` made by ``row_of``, some replaced."""
    return [instead[c].alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in docs.columns]


def prefix_sums(df: DataFrame, group: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Add exclusive running sums within ``group`` in the order ``order``.

    Rows are dealt by range of (group, order), so a group of any size spreads
    over many tasks; the totals of (partition, group) give each its offset.
    ``order`` must be total up to rows that are equal in all that matters.
    """
    spark = df.sparkSession
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    ranged = staged(
        df.withColumns({f"_v_{n}": c for n, c in sums.items()})
        .repartitionByRange(partitions(spark), *keys)
        .withColumn("_pid", F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group, "_pid").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    if not group:
        before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.col("_pid").alias("_opid"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    on = here["_pid"] == offsets["_opid"]
    for g in group:
        on &= here[g].eqNullSafe(offsets[f"_g_{g}"])
    out = here.join(offsets, on, "left").withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return out.select(*df.columns, *sums)
