"""The job store as two tables, ``jobs`` and ``quality_logs``, with the calls that a dashboard makes.

Every call returns a DataFrame or changes a table. Both tables lie in buckets by a hash of the project, so that a change
of one job rewrites its bucket alone: the bucket's new rows are written to the shared folder first and read from there, then
put in place of its old files by Spark's dynamic overwrite, which moves files in when all of them are written. A job that
fails before that moment leaves the old contents; Parquet has no transactions, so one that fails while files are moved may
leave a bucket without them, and the rows are still in the shared folder until the driver ends. There is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import quality as ql
from .operators import state as stt
from .operators import timeline as tl
from .runtime import Tables

RESETTABLE = ["created", "scripting", "bootstrapping", "generating", "mastering", "exporting"]


class Store:
    def __init__(self, spark: SparkSession, database: str = "quill", buckets: int = 16):
        """``buckets`` is how many parts the tables have; it may not change while they exist."""
        self.spark, self.database, self.buckets = spark, database, buckets
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.jobs ({schemas.JOBS}, bucket INT) USING parquet PARTITIONED BY (bucket)")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.quality_logs ({schemas.QUALITY_LOGS}, bucket INT) USING parquet PARTITIONED BY (bucket)")

    # tables

    def _rows(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}").drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64("project_id"), F.lit(self.buckets)).cast("int")

    def jobs(self) -> DataFrame:
        """Jobs, the one updated last first."""
        return self._rows("jobs").orderBy(F.desc("updated_at"), "project_id")

    def quality_logs(self, project_id: str | None = None, chapter: int | None = None) -> DataFrame:
        rows = self._rows("quality_logs")
        rows = rows if project_id is None else self._of(rows, "quality_logs", project_id)
        rows = rows if chapter is None else rows.where(F.col("chapter_number") == chapter)
        return rows.orderBy("chapter_number", "line_id", "attempt")

    def _of(self, rows: DataFrame, name: str, project_id: str) -> DataFrame:
        """The rows of a project, from its bucket alone."""
        here = self.spark.range(1).select(F.lit(project_id).alias("project_id")).select(self._bucket()).first()[0]
        return self.spark.table(f"{self.database}.{name}").where((F.col("bucket") == here) & (F.col("project_id") == project_id)).drop("bucket")

    def change(self, name: str, keys: DataFrame, rows: DataFrame | None = None) -> None:
        """Put ``rows`` in place of all rows whose project is one of ``keys(project_id)``; None: delete them.

        Only the buckets of these projects are read and written. A bucket that loses all its rows is dropped.
        """
        table = f"{self.database}.{name}"
        stage = Tables()
        touched = stage(keys.select("project_id").distinct().withColumn("bucket", self._bucket()), "keys")
        buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not buckets:
            stage.close()
            return
        old = self.spark.table(table).where(F.col("bucket").isin(buckets)).join(touched.select("project_id"), "project_id", "left_anti")
        columns = self.spark.table(table).columns
        new = old.select(*columns)
        if rows is not None:
            new = new.unionByName(rows.withColumn("bucket", self._bucket()).select(*columns))
        new = stage(new, name)
        conf, mode = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(mode)
        conf.set(mode, "dynamic")
        try:
            new.repartition("bucket").write.mode("overwrite").insertInto(table, overwrite=True)
        finally:
            conf.set(mode, before)
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        have = {r[0] for r in self.spark.sql(f"SHOW PARTITIONS {table}").collect()}
        for b in set(buckets) - left:
            if f"bucket={b}" in have:
                self.spark.sql(f"ALTER TABLE {table} DROP PARTITION (bucket = {b})")
        stage.close()

    # jobs

    def create_job(self, project_id: str, state: dict) -> None:
        """Insert or replace a job."""
        row = self.spark.range(1).select(F.lit(project_id).alias("project_id"), F.lit(json.dumps(state, default=str)).alias("state"), _now().alias("created_at"), _now().alias("updated_at"))
        self.upsert_jobs(row)

    def upsert_jobs(self, rows: DataFrame) -> None:
        """Insert or replace many jobs ``(project_id, state, created_at, updated_at)``, of distinct projects, at once."""
        self.change("jobs", rows, rows)

    def job(self, project_id: str) -> dict:
        """The state of a job; KeyError if there is none."""
        row = self._of(self._rows("jobs"), "jobs", project_id).first()
        if row is None:
            raise KeyError(project_id)
        return json.loads(row["state"])

    def update_state(self, project_id: str, **fields) -> None:
        """Merge fields into a job's state, shallowly."""
        merged = json.dumps({**self.job(project_id), **fields}, default=str)
        row = self._of(self._rows("jobs"), "jobs", project_id)
        self.upsert_jobs(row.withColumns({"state": F.lit(merged), "updated_at": _now()}))

    def delete_job(self, project_id: str) -> None:
        """Delete a job and its logs; an unknown one is no error."""
        self.delete_jobs(self.spark.range(1).select(F.lit(project_id).alias("project_id")))

    def delete_jobs(self, keys: DataFrame) -> None:
        """Delete the jobs of ``keys(project_id)`` and their logs, logs first."""
        for name in ("quality_logs", "jobs"):
            self.change(name, keys)

    def start(self, project_id: str) -> list[str]:
        """The stages that a run goes through; ValueError if the job is running."""
        status = self.job(project_id).get("status", "created")
        if status in stt.STAGES:
            raise ValueError(f"{project_id} is running")
        return self.spark.range(1).select(stt.stages_to_run(F.lit(status))).first()[0]

    def stop(self, project_id: str) -> None:
        self.update_state(project_id, status="paused", stop_requested=True)

    def reset(self, project_id: str, stage: str) -> None:
        """Set the status back to a stage; what was done before stays."""
        if stage not in RESETTABLE:
            raise ValueError(stage)
        self.update_state(project_id, status=stage)

    def select_chapters(self, project_id: str, chapters: str | list[int]) -> None:
        """Select chapters by list or by ranges such as ``1-5,8``; all of them is no selection."""
        spec = chapters if isinstance(chapters, str) else ",".join(map(str, chapters))
        total = int(self.job(project_id).get("total_chapters", 0))
        chosen = self.spark.range(1).select(stt.all_or_list(stt.chapter_ranges(F.lit(spec)), F.lit(total))).first()[0]
        self.update_state(project_id, selected_chapters=chosen)

    def request_deploy(self, project_id: str, wanted: bool = True) -> None:
        self.update_state(project_id, deploy_requested=wanted)

    # reports

    def log_quality(self, rows: DataFrame) -> None:
        """Append attempts; columns that ``rows`` lacks are null."""
        have = {f.name: f.dataType for f in self._rows("quality_logs").schema}
        new = rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()])
        new.withColumn("bucket", self._bucket()).write.insertInto(f"{self.database}.quality_logs")

    def chapter_quality(self, project_id: str) -> DataFrame:
        return ql.chapter_summary(self.quality_logs(project_id))

    def project_quality(self, project_id: str) -> DataFrame:
        return ql.project_summary(self.quality_logs(project_id))

    def lights(self, project_id: str) -> DataFrame:
        return ql.traffic_lights(self.project_quality(project_id))

    def progress(self) -> DataFrame:
        """Status, coarse status and percent of every job."""
        part = lambda k: F.get_json_object("state", f"$.{k}")
        done, total = F.coalesce(part("chapters_generated").cast("int"), F.lit(0)), F.coalesce(part("total_chapters").cast("int"), F.lit(0))
        return self.jobs().select("project_id", part("status").alias("status"), stt.coarse_status(part("status")).alias("shown"), stt.stage_percent(part("status"), done, total).alias("percent"))

    def markers(self, durations: DataFrame) -> DataFrame:
        return tl.chapter_markers(durations)


def _now():
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
