"""Session helpers: the shared checkpoint folder, staged tables and distributed ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and driver and executors are one process (local tests) a temporary folder
    is made and set; on a cluster the executors would each write to a disk of their own, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when it ends, else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, survives lost executors, gives later joins a plain scan (so that adaptive
    execution can split skewed partitions), and the files go when the driver ends. The shuffle files of the
    write go with it: an operator of many steps holds those of one step, not of all so far.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = target
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read any more."""
    for t in tables:
        conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        t._staged_at.getFileSystem(conf).delete(t._staged_at, True)


class Tables:
    """The staged tables of one operator, so that those which its result doesn't read go when it returns."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(staged(df, label))
        return self.held[-1]

    def hold(self, table: DataFrame) -> DataFrame:
        """Take over a staged table that a helper returned."""
        self.held.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        release(*tables)
        self.held = [t for t in self.held if not any(t is d for d in tables)]

    def close(self, *keep: DataFrame) -> None:
        self.drop(*(t for t in self.held if not any(t is k for k in keep)))


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """An equi-join condition on ``names`` in which null meets null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


#: Leaves of more rows than this are split further, by the whole sort key and then by place.
LEAF_ROWS = 1_000_000


def gapless_rank(df: DataFrame, group: str, levels: list[str], order: str, out: str, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Add ``out``: the 0-based position of each row in its ``group``, with no task holding a whole group.

    ``levels`` are columns of which each splits what the one before holds, consistently with the column
    ``order`` (e.g. the leading characters of the sort key); none of these columns holds nulls, and ``df`` has
    no columns ``_n``, ``_r``, ``_hot``, ``_tie``, ``_salt``, ``_base`` and ``_o1`` on. Rows are counted per leaf,
    leaf counts are summed level by level over a few hundred rows at a time, and only the rows of one leaf are
    sorted together. Rows that tie take any of their positions; a leaf of more than ``leaf_rows`` rows, such as
    one of very many equal keys, is split by the key and ties by the place of the row in a written table.
    """
    stage, keys, columns = Tables(), [group, *levels], df.columns

    def counted(rows: DataFrame) -> DataFrame:
        return stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "leaves")

    sizes = counted(df)
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most > leaf_rows:
        hot = sizes.where(F.col("_n") > leaf_rows).select(*keys, F.lit(True).alias("_hot"))
        tie = F.when(F.col("_hot"), F.col(order)).otherwise(F.lit(0).cast(df.schema[order].dataType))
        salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(most // leaf_rows + 1))).otherwise(0)
        df = stage(df.join(hot, keys, "left").select(*columns, tie.alias("_tie"), salt.alias("_salt")), "salted")
        keys = [*keys, "_tie", "_salt"]
        sizes = counted(df)
    base = sizes.select(*keys)
    for depth in range(1, len(keys)):
        at = sizes.groupBy(*keys[: depth + 1]).agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*keys[:depth]).orderBy(keys[depth]).rowsBetween(Window.unboundedPreceding, -1)
        at = at.select(*keys[: depth + 1], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_o{depth}"))
        base = base.join(at, keys[: depth + 1])
    base = stage(base.select(*keys, sum((F.col(f"_o{d}") for d in range(1, len(keys))), F.lit(0)).alias("_base")), "rank")
    stage.close(base, df)
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.join(base, keys).select(*columns, (F.col("_base") + F.col("_r") - 1).cast("long").alias(out))


def totals_before(df: DataFrame, group: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add for each ``name: column`` of ``sums`` the total of ``column`` over the rows before, within ``group``.

    Rows are cut into ranges of (group, order), so that no task holds a large group; totals of ranges are summed
    over as many rows a group as there are ranges, and only the rows of one range are sorted together. Nulls
    count as 0; rows that tie in ``order`` come in any order. ``df`` should be narrow and has no columns ``_at``, ``_base``.
    """
    cut = staged(df.repartitionByRange(group, *order).withColumn("_at", F.spark_partition_id()), "ranges")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    totals = cut.groupBy(group, "_at").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    base = totals.select(group, "_at", F.struct(*(before(n, Window.partitionBy(group).orderBy("_at")).alias(n) for n in sums)).alias("_base"))
    inner = Window.partitionBy(group, "_at").orderBy(*order)
    rows = cut.select("*", *(before(c, inner).alias(n) for n, c in sums.items()))
    out = rows.join(base, null_safe(rows, base, group, "_at"))
    return out.select(*(rows[c] for c in df.columns), *((rows[n] + base["_base"][n]).alias(n) for n in sums))
