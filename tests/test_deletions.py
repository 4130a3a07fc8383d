"""Deletion plans applied with a ledger: resumption, tombstones, failures, compaction."""

import pytest
from pyspark.sql import functions as F

from citeflow.operators import deletions, sessions
from tests.test_sessions import events


@pytest.fixture(scope="module")
def story(spark):
    """Channel 1 holds most messages, in three pages; its end is event 250."""
    rows = [(1, "message", "x", "b1" if i % 3 == 0 else None, None) for i in range(250)]
    return events(spark, [*rows, (1, "end", None, None, None), (2, "message", "y", None, None), (2, "end", None, None, None),
                          (3, "message", "stays", None, None)])


def calls_of(folder):
    return sorted(int(line) for f in folder.iterdir() for line in f.read_text().split())


def recorder(folder, broken=()):
    """Writes down every message it deletes; raises for the pages in ``broken``."""
    import uuid

    folder.mkdir(exist_ok=True)

    def delete(rows):
        if (int(rows["channel"].iloc[0]), int(rows["page_no"].iloc[0])) in broken:
            raise ConnectionError("no answer")
        (folder / uuid.uuid4().hex).write_text(" ".join(str(i) for i in rows["event_id"]))
        return [None] * len(rows)

    return delete


def test_a_broken_run_resumes(spark, story, tmp_path):
    plan, path, seen = sessions.deletion_plan(story), str(tmp_path / "ledger"), tmp_path / "calls"
    first = deletions.apply_deletions(plan, path, recorder(seen, {(1, 1)}))
    assert first.where("deleted").count() == 151 and first.where("NOT deleted").count() == 100
    assert first.where("error LIKE 'ConnectionError%'").count() == 100
    assert [r["event_id"] for r in deletions.failed_ends(spark, path).collect()] == [250]
    notices = {r.event_id: r.notice for r in sessions.end_session(story, deletions.failed_ends(spark, path)).collect()}
    assert notices == {250: sessions.NOT_ENDED, 252: sessions.ENDED}
    left = {r["event_id"] for r in deletions.live_messages(story, path).where("kind = 'message'").collect()}
    assert left == {*range(50, 150), 253}
    again = deletions.apply_deletions(plan, path, recorder(seen))
    assert again.where("deleted").count() == 251 and deletions.failed_ends(spark, path).isEmpty()
    # every message was deleted once, over both runs
    assert calls_of(seen) == [*range(250), 251]
    assert deletions.apply_deletions(plan, path, recorder(seen)).count() == 351 and len(calls_of(seen)) == 251
    assert {r["event_id"] for r in deletions.live_messages(story, path).where("kind = 'message'").collect()} == {253}


def test_a_run_that_dies_keeps_its_finished_waves(spark, story, tmp_path, monkeypatch):
    plan, path, seen = sessions.deletion_plan(story), str(tmp_path / "ledger"), tmp_path / "calls"
    original, waves = deletions.F.xxhash64, []

    def dies(*columns):
        waves.append(1)
        if len(waves) == 2:
            raise KeyboardInterrupt
        return original(*columns)

    monkeypatch.setattr(deletions.F, "xxhash64", dies)
    with pytest.raises(KeyboardInterrupt):
        deletions.apply_deletions(plan, path, recorder(seen), pages_a_wave=2)
    monkeypatch.setattr(deletions.F, "xxhash64", original)
    done = len(calls_of(seen))
    assert done == deletions.tombstones(spark, path).count()
    deletions.apply_deletions(plan, path, recorder(seen), pages_a_wave=2)
    assert calls_of(seen) == [*range(250), 251]


def test_partial_outcomes_and_compaction(spark, story, tmp_path):
    plan, path = sessions.deletion_plan(story), str(tmp_path / "ledger")
    deletions.apply_deletions(plan, path, lambda rows: [None if i % 2 else "locked" for i in rows["event_id"]])
    assert deletions.tombstones(spark, path).count() == 126
    deletions.apply_deletions(plan, path, lambda rows: [None if i % 4 else "locked" for i in rows["event_id"]])
    before = sorted(tuple(r) for r in deletions.tombstones(spark, path).collect())
    failed = deletions.failed_ends(spark, path).collect()
    assert deletions.ledger(spark, path).count() == 251 + 125
    deletions.compact(spark, path)
    assert sorted(tuple(r) for r in deletions.tombstones(spark, path).collect()) == before
    assert deletions.failed_ends(spark, path).collect() == failed and deletions.ledger(spark, path).count() == 251
    deletions.apply_deletions(plan, path, lambda rows: [None] * len(rows))
    assert deletions.tombstones(spark, path).count() == 251
    wrong = deletions.apply_deletions(plan, str(tmp_path / "other"), lambda rows: [])
    assert wrong.where(F.col("error").contains("0 outcomes")).count() == 251


def test_empty_plan(spark, story, tmp_path):
    path = str(tmp_path / "ledger")
    assert deletions.apply_deletions(sessions.deletion_plan(story).limit(0), path, lambda rows: []).count() == 0
    assert deletions.live_messages(story, path).count() == story.count()
    deletions.compact(spark, path)
