import pytest

from checks.frames import dirty_profile
from patronlens import schema, versions
from patronlens.plans import training as plans
from patronlens.plans.scoring import ModelSet, read_scored, score_batch
from patronlens.streaming.scoring import score_stream


def test_numbers_names_and_pruning(spark, tmp_path):
    root = str(tmp_path)
    assert not versions.is_versioned(spark, root) and versions.published(spark, root) == {}
    with pytest.raises(ValueError, match="no published version"):
        versions.current(spark, root)
    for i, name in enumerate("abcd"):
        (tmp_path / name).mkdir()
        assert versions.publish(spark, root, name) == i
    assert versions.current(spark, root) == f"{root}/d" and versions.current(spark, root, 1) == f"{root}/b"
    versions.publish(spark, root, "e", 3)  # a second writer with the same number
    assert versions.published(spark, root)[3] == f"{root}/e"
    versions.prune(spark, root, 2)
    assert sorted(versions.published(spark, root)) == [2, 3]
    assert not (tmp_path / "a").exists() and (tmp_path / "c").exists()
    with pytest.raises(ValueError, match="version 0"):
        versions.current(spark, root, 0)


def test_a_save_that_dies_leaves_the_version_before(spark, training, tmp_path, monkeypatch):
    path = str(tmp_path / "models")
    assert training.publish(spark, path) == 0
    before = versions.current(spark, path)

    def broken(*_):
        raise OSError("disk lost")

    monkeypatch.setattr(plans, "write_report", broken)
    with pytest.raises(OSError):
        training.publish(spark, path)
    monkeypatch.undo()
    assert versions.current(spark, path) == before
    models, stats = plans.load_published(spark, path)
    assert isinstance(models, ModelSet) and stats == training.data.stats
    assert training.publish(spark, path, keep=1) == 1
    assert list(versions.published(spark, path)) == [1]


def test_a_batch_is_seen_whole_and_once(spark, folder, training, tmp_path):
    """A batch folder without its marker is not read; the repeated batch writes it anew, a published one is skipped."""
    incoming, out = str(tmp_path / "in"), str(tmp_path / "out")
    dirty_profile(spark, folder).select(*schema.SCORING.names).coalesce(1).write.parquet(incoming)
    source = spark.readStream.schema(schema.SCORING_TEXT).parquet(incoming)
    versions.prepare(spark, out)
    rows = spark.read.schema(schema.SCORING_TEXT).parquet(incoming)
    score_batch(rows.limit(5), training.models, f"{out}/batch_id=0")
    assert read_scored(spark, out).count() == 0
    score_stream(source, training.models, out, str(tmp_path / "state")).awaitTermination()
    assert read_scored(spark, out).count() == rows.count()
    # The stream's own record of the batch is lost: it comes again, under the same number.
    score_stream(source, training.models, out, str(tmp_path / "other-state")).awaitTermination()
    assert read_scored(spark, out).count() == rows.count()
    assert list(versions.published(spark, out)) == [0]
