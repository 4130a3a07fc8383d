"""Slices of a stream: only channels of many events make them."""

from pyspark.sql import functions as F

from checks import registry
from citeflow.streaming import channels


def write_events(spark, folder, hot):
    """300 channels of ten events, of which channel 0 has ``hot`` more."""
    ids = spark.range(3000 + hot)
    user = F.when(F.col("id") < 3000, F.col("id") % 300).otherwise(0)
    ids.select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7 % 10007).alias("ts"), user.alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(5.0).alias("value"), F.lit("x").alias("props"),
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_only_large_channels_make_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "EVENTS_A_SLICE", 500)
    many = write_events(spark, tmp_path / "many", 0)
    assert len(list(registry.event_slices(spark, many))) == 1
    hot = write_events(spark, tmp_path / "hot", 2000)
    slices = list(registry.event_slices(spark, hot))
    assert len(slices) > 3 and sum(s.count() for s in slices) == 5000
    for s in slices:
        assert s.where("user_id = 0").count() <= 550
    for sf in (many, hot):
        streamed = registry.channel_history_state(spark, sf)
        batch = registry.channel_history_state_batch(spark, sf).select(*streamed.columns)
        assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_a_slice_is_one_batch(spark, tmp_path):
    sf = write_events(spark, tmp_path / "e", 0)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    big = registry.slice_stream(spark, f"{sf}/events.parquet", schema)
    rows = channels.run_to_end(big.select("event_id"), "one", str(tmp_path / "out"))
    assert rows.count() == 3000 and len(list((tmp_path / "out" / "progress" / "offsets").glob("[0-9]*"))) == 1
