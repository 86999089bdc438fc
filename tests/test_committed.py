"""Captures that count once, from their manifest on."""

from datetime import datetime, timedelta, timezone

import pytest

from apilens import schemas
from apilens.sources import captures, committed

NAMES = [part.split()[0] for part in schemas.HTTP_MESSAGES.split(", ")]


def records(spark, *ids):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [{"id": i, "type": "request", "ts": start + timedelta(seconds=n), "endpoint": "/a"} for n, i in enumerate(ids)]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], schemas.HTTP_MESSAGES)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "captures")
    assert committed.read_committed(spark, path).count() == 0
    assert committed.commit_captures(records(spark, "1", "2"), path, 0)
    assert not committed.commit_captures(records(spark, "1", "2"), path, 0)
    # an attempt that dies between its records and its manifest
    with monkeypatch.context() as m:
        m.setattr(spark, "range", None)
        with pytest.raises(TypeError):
            committed.commit_captures(records(spark, "3"), path, 1)
    assert ids(captures.read_captures(spark, f"{path}/data/capture/*")) == ["1", "2", "3"]
    assert ids(committed.read_committed(spark, path)) == ["1", "2"]
    assert committed.commit_captures(records(spark, "3"), path, 1)
    assert ids(committed.read_committed(spark, path)) == ["1", "2", "3"]


def test_late_writers_move_no_position(spark, tmp_path):
    """A slow writer commits after an extract what it wrote before it; nothing is skipped or taken twice."""
    path, position = str(tmp_path / "captures"), str(tmp_path / "position")
    taken = []

    def extract(again=False):
        new, reached = committed.read_new(spark, path, position)
        found = ids(new)
        for _ in range(1 + again):
            committed.write_position(reached, position)
        taken.extend(found)
        return found

    assert extract() == []
    committed.commit_captures(records(spark, "a0"), path, 0, "a")
    committed.commit_captures(records(spark, "b0"), path, 5, "b")
    assert extract(again=True) == ["a0", "b0"]
    committed.commit_captures(records(spark, "a1"), path, 1, "a")
    committed.commit_captures(records(spark), path, 6, "b")
    assert extract() == ["a1"]
    committed.commit_captures(records(spark, "b7"), path, 7, "b")
    assert extract() == ["b7"] and extract() == []
    assert sorted(taken) == ids(committed.read_committed(spark, path))
