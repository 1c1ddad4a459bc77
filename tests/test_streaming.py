import pandas as pd

from tessera.streaming import sessions


def run(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def source(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.orderBy("ts").repartition(1).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def test_windows(spark, sf, tmp_path):
    events, stream = source(spark, sf, tmp_path)
    out = run(spark, sessions.windowed_counts(stream, "ts", "event_type", "1 day"), "windows", "complete")
    assert out.agg({"n": "sum"}).first()[0] == events.count()


def test_transitions(spark, sf, tmp_path):
    events, stream = source(spark, sf, tmp_path)
    out = run(spark, sessions.transitions(stream, "user_id", "event_type", "event_id"), "moves")
    assert out.count() == events.count() - events.select("user_id").distinct().count()


def test_sessions(spark, sf, tmp_path):
    events, stream = source(spark, sf, tmp_path)
    out = run(spark, sessions.sessions(stream, "ts", "user_id"), "sessions")
    # what ended more than the gap and the lateness before the last event has been given out, whole
    done = events.selectExpr("user_id", "CAST(ts AS timestamp) AS t").toPandas().sort_values(["user_id", "t"])
    new = (done["user_id"] != done["user_id"].shift()) | (done["t"].diff() > pd.Timedelta("30 minutes"))
    last = done.groupby(new.cumsum()).agg(user=("user_id", "first"), t=("t", "max"), n=("t", "size"))
    want = last[last["t"] + pd.Timedelta("40 minutes") < done["t"].max()]
    got = out.toPandas()
    assert len(want) and sorted(zip(got["user_id"], got["n"])) == sorted(zip(want["user"], want["n"]))
