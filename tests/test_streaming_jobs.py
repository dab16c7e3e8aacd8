import json
import time

from gneiss.streaming import jobs

STEPS = "job_id string, ts timestamp, state string"


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"job_id": j, "ts": f"2024-01-01T00:00:{t:02}Z", "state": s}) for j, t, s in rows))


def test_states_are_kept_between_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    seen = {}

    def keep(batch, _):
        seen.update({r.job_id: (r.state, r.n_steps, r.n_broken) for r in batch.collect()})

    log = jobs.ProgressLog()
    spark.streams.addListener(log)
    for n, rows in enumerate([[("a", 1, "queued"), ("b", 1, "running"), ("a", 2, "running")], [("a", 3, "succeeded"), ("a", 4, "queued"), ("b", 5, "queued")]]):
        write(source, f"{n}.json", rows)
        stream = jobs.job_states(spark.readStream.schema(STEPS).json(str(source)))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == {"a": ("succeeded", 4, 1), "b": ("queued", 2, 1)}
    for _ in range(50):
        if any("event=ended" in x for x in log.lines):
            break
        time.sleep(0.1)
    spark.streams.removeListener(log)
    assert any(x.startswith("event=progress") and "rows=3" in x for x in log.lines)


def test_repeated_submissions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, "0.json", [("a", 1, "x"), ("a", 2, "x"), ("b", 3, "x")])
    got = []
    stream = jobs.distinct_jobs(spark.readStream.schema(STEPS).json(str(source)), ["job_id", "state"])
    stream.writeStream.foreachBatch(lambda b, _: got.extend(r.job_id for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(got) == ["a", "b"]
