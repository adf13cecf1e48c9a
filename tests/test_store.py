"""The job store, call by call."""

import pytest

from quillspark.store import Store


def test_store(spark):
    store = Store(spark, "quill_test")
    store.create_job("a", {"status": "created", "total_chapters": 3, "chapters_generated": 1})
    store.create_job("b", {"status": "complete"})
    store.create_job("a", {"status": "created", "total_chapters": 4, "chapters_generated": 1})
    assert store.job("a")["total_chapters"] == 4 and store.jobs().count() == 2
    assert store.start("a")[0] == "scripting" and store.start("b") == []
    store.update_state("a", status="generating", cover=None)
    with pytest.raises(ValueError):
        store.start("a")
    store.stop("a")
    assert store.job("a")["status"] == "paused" and store.job("a")["total_chapters"] == 4
    store.select_chapters("a", "1-2,9")
    assert store.job("a")["selected_chapters"] == [1, 2, 9]
    store.select_chapters("a", [1, 2, 3, 4])
    assert store.job("a")["selected_chapters"] is None
    store.reset("a", "mastering")
    with pytest.raises(ValueError):
        store.reset("a", "nonsense")
    with pytest.raises(KeyError):
        store.job("zzz")
    rows = spark.createDataFrame([(1, "a", "l1", 1, 1, 0.2, 0.5, "fail"), (2, "a", "l1", 1, 2, 0.0, 0.9, "pass"), (3, "b", "l1", 1, 1, 0.0, 0.9, "pass")], "id long, project_id string, line_id string, chapter_number int, attempt int, wer double, quality_score double, status string")
    store.log_quality(rows)
    assert store.chapter_quality("a").first().total_retries == 1
    assert store.project_quality("a").first().passed_segments == 1 and store.lights("a").first().rate_light == "good"
    assert {r.project_id: (r.shown, r.percent) for r in store.progress().collect()} == {"a": ("running", 25.0), "b": ("complete", 100.0)}
    store.delete_job("a")
    store.delete_job("unknown")
    assert store.jobs().count() == 1 and store.quality_logs().count() == 1


def test_a_change_rewrites_its_bucket_alone(spark):
    store = Store(spark, "quill_buckets", buckets=4)
    rows = spark.range(40).selectExpr("concat('p', id) as project_id", "'{}' as state", "'t' as created_at", "concat('t', id) as updated_at")
    store.upsert_jobs(rows)
    store.log_quality(spark.createDataFrame([(i, f"p{i}", "l", 1, 1) for i in range(40)], "id long, project_id string, line_id string, chapter_number int, attempt int"))

    def files(name):
        found = {}
        for r in spark.table(f"quill_buckets.{name}").selectExpr("bucket", "_metadata.file_name as f").distinct().collect():
            found.setdefault(r.bucket, set()).add(r.f)
        return found

    before = files("jobs"), files("quality_logs")
    assert len(before[0]) == 4
    store.update_state("p7", status="paused")
    after = files("jobs")
    assert sum(after[b] != before[0][b] for b in after) == 1 and store.job("p7") == {"status": "paused"} and store.jobs().count() == 40
    store.delete_jobs(spark.createDataFrame([("p7",), ("unknown",)], "project_id string"))
    assert store.jobs().count() == store.quality_logs().count() == 39 and store.quality_logs("p7").count() == 0
    gone = [r.project_id for r in spark.table("quill_buckets.jobs").where("bucket = 1").collect()]
    store.delete_jobs(spark.createDataFrame([(p,) for p in gone], "project_id string"))
    assert 1 not in files("jobs") and store.jobs().count() == 39 - len(gone)
    store.delete_jobs(spark.createDataFrame([], "project_id string"))
    assert store.jobs().count() == 39 - len(gone)
