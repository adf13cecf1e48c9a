"""Where streams write: each batch once, whatever is repeated, and progress as it is made."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)

LEDGER = "query string, batch long, rows long, written_at timestamp"


class OnceTable:
    """A table of Parquet files to which every batch of a query adds its rows once.

    ``append`` may be given to ``foreachBatch``. A batch's rows go to a folder of their own, ``query=.../batch=...``, which
    a repeated batch overwrites, and then a line into the ledger. ``rows`` shows batches that are in the ledger only. So a
    batch that failed halfway shows nothing, one that comes again after it was written is skipped, and one that
    was written but not entered is written anew in the same place. Two writers must not share a query name.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.data, self.book, self.schema = spark, f"{path}/data", f"{path}/ledger", schema
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.book)

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.book)

    def written(self, query: str, batch: int) -> bool:
        return bool(self.ledger().where((F.col("query") == query) & (F.col("batch") == batch)).head(1))

    def append(self, rows: DataFrame, query: str, batch: int) -> bool:
        """Add a batch; False if it was there already."""
        if self.written(query, batch):
            return False
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self._empty().schema.fields))
        folder = f"{self.data}/query={query}/batch={batch}"
        rows.write.mode("overwrite").parquet(folder)
        count = self.spark.read.schema(self.schema).parquet(folder).count()
        line = self.spark.range(1).select(F.lit(query).alias("query"), F.lit(batch).cast("long").alias("batch"), F.lit(count).cast("long").alias("rows"), F.current_timestamp().alias("written_at"))
        line.coalesce(1).write.mode("append").parquet(self.book)
        return True

    def sink(self, query: str):
        """For ``foreachBatch``."""
        return lambda rows, batch: self.append(rows, query, batch) and None

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """All rows of batches in the ledger, with ``query`` and ``batch``."""
        entered = self.ledger().select("query", "batch").distinct()
        if not entered.head(1):
            return self._empty().select("*", F.lit("").alias("query"), F.lit(0).cast("long").alias("batch")).where("false")
        files = self.spark.read.schema(f"{self.schema}, query string, batch long").option("basePath", self.data).parquet(self.data)
        return files.join(entered, ["query", "batch"], "left_semi")


def observed(rows: DataFrame, name: str, **sums: Column) -> DataFrame:
    """``rows`` as they are, counted as they pass: ``rows`` and further aggregates reach a ``ProgressTable`` of that name."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in sums.items()))


class ProgressTable(StreamingQueryListener):
    """Progress of observed streams as a table: a row for each batch and name, and a call for each.

    Counting is part of the pass that a stream makes anyway. ``call(query, batch, metrics)`` may fail without
    harm to the stream. Rows ``(query, batch, name, rows, metrics)`` go to ``sink``, each batch once.
    """

    SCHEMA = "query string, number long, name string, rows long, metrics map<string,string>"

    def __init__(self, table: OnceTable | None = None, call=None) -> None:
        self.table, self.call = table, call

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        query = p.name or str(p.id)
        found = {name: row.asDict() for name, row in p.observedMetrics.items()}
        if not found:
            return
        if self.call:
            for name, metrics in found.items():
                try:
                    self.call(query, p.batchId, {"name": name, **metrics})
                except Exception:
                    log.warning("Progress call failed", exc_info=True)
        if self.table:
            rows = [(query, p.batchId, name, m.get("rows"), {k: str(v) for k, v in m.items()}) for name, m in found.items()]
            self.table.append(self.table.spark.createDataFrame(rows, self.SCHEMA), query, p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
