"""The store of newest messages against windows over the whole transcript."""

import random

import pytest
from pyspark.sql import functions as F

from citeflow.operators.history import history_window
from citeflow.sources import recent


def rows_of(df):
    return sorted(tuple(r) for r in df.select("conv_id", "turn", "role", "content").collect())


@pytest.fixture(scope="module")
def talk(spark):
    """Conversation 0 holds a third of all messages."""
    rng, turns, rows = random.Random(4), {}, []
    for i in range(300):
        c = 0 if rng.random() < 0.33 else rng.randint(1, 30)
        turns[c] = turns.get(c, 0) + 1
        rows.append((c, turns[c], rng.choice(["user", "assistant"]), None if i % 17 == 0 else f"m{i}", i))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, content string, i int")


@pytest.mark.parametrize("cuts", [[], [150], [10, 11, 90, 240]])
def test_any_split_gives_the_same_window(spark, talk, tmp_path, cuts):
    path = str(tmp_path / "recent")
    for b, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 999], strict=True)):
        recent.update_recent(talk.where((F.col("i") > low) & (F.col("i") <= high)), path, b, kept=6, buckets=4)
    for n in (1, 3, 6):
        assert rows_of(recent.recent_window(spark, path, n)) == rows_of(history_window(talk, n))
    assert recent.read_recent(spark, path).count() < 31 * 6 + 1
    recent.drop_old_versions(spark, path)
    assert rows_of(recent.recent_window(spark, path, 6)) == rows_of(history_window(talk, 6))


def test_late_and_repeated_turns(spark, talk, tmp_path):
    path = str(tmp_path / "recent")
    odd = F.col("turn") % 2 == 1
    recent.update_recent(talk.where(~odd), path, 0, kept=300)
    recent.update_recent(talk.where(odd), path, 1, kept=300)
    assert rows_of(recent.recent_window(spark, path, 5)) == rows_of(history_window(talk, 5))
    # the same batch again, and a turn that is told anew
    recent.update_recent(talk.where(odd), path, 1, kept=300)
    assert rows_of(recent.read_recent(spark, path)) == rows_of(talk)
    anew = spark.createDataFrame([(3, 1, "user", "other")], recent.SCHEMA)
    recent.update_recent(anew, path, 2, kept=300)
    got = rows_of(recent.read_recent(spark, path))
    assert (3, 1, "user", "other") in got and len(got) == talk.count()


def test_only_touched_folders_are_read_and_written(spark, talk, tmp_path):
    path = str(tmp_path / "recent")
    recent.update_recent(talk, path, 0, buckets=8)
    one = spark.createDataFrame([(5, 1000, "user", "now")], recent.SCHEMA)
    bucket = one.select(recent.bucket_of(8)).first()[0]
    recent.update_recent(one, path, 1, buckets=8)
    versions = recent._versions(spark, path)
    assert [b for b, v in versions.items() if v == [0, 1]] == [bucket] and len(versions) > 4
    files = recent._newest(spark, path, [bucket]).inputFiles()
    assert files and all(f"/version=1/bucket={bucket}/" in f for f in files)
    got = rows_of(recent.read_recent(spark, path, one, buckets=8))
    assert {r[0] for r in got} == {5} and (5, 1000, "user", "now") in got
    recent.update_recent(talk.limit(0), path, 2)
    assert recent._versions(spark, path) == versions
