"""Replays read tables that are folders of part files, in several batches with state between."""

import pytest

from lookout.streaming import replay


@pytest.mark.parametrize("name, used", [("stream_alerts", "documents"), ("stream_streak", "events")])
def test_folders_and_single_files_give_the_same(name, used, spark, sf_dir, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf_dir}/{used}.parquet").repartition(4).write.parquet(f"{tmp_path}/{used}.parquet")
    total, batches, start = spark.read.parquet(f"{sf_dir}/{used}.parquet").count(), {}, replay.poll.start

    def counted(stream, run, checkpoint):
        def both(batch, batch_id):
            batches[batch_id] = batch.count()
            run(batch, batch_id)
        return start(stream, both, checkpoint)

    query = getattr(replay, name)
    want = sorted(map(tuple, query(spark, sf_dir).collect()), key=repr)
    monkeypatch.setattr(replay.poll, "start", counted)
    got = sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and got
    assert len(batches) == replay.PARTS and sum(batches.values()) == total
