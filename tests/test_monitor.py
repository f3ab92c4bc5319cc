"""Feed, keyed state, the monitor's loop and windowed counts, with restarts."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import alerts, feed, packages, state

ENTRY = "package_name string, version string, link string, pub_date timestamp, error string"


def rss(*items):
    tags = lambda t, l, d: f"<item><title>{t}</title><link>{l}</link><pubDate>{d}</pubDate></item>"  # noqa: E731, E741
    return "<rss><channel><title>news</title>" + "".join(tags(*i) for i in items) + "</channel></rss>"


A = ("alpha 1.0", "http://e/a", "Mon, 02 Jan 2023 10:00:00 GMT")
B = ("beta two 2.0", "http://e/b", "Mon, 02 Jan 2023 11:00:00 +0100")
C = ("gamma 3.0", "http://e/c", "Mon, 02 Jan 2023 12:00:00 GMT")
BAD = [("noversion", "http://e/d", ""), ("delta 4.0", "", "yesterday")]


def drain(spark, rows, path, checkpoint, schema):
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()), key=str)


def test_feed_items():
    got = [row for _, row in feed.items(rss(A, B, *BAD).encode())]
    assert [r[:3] for r in got] == [("alpha", "1.0", "http://e/a"), ("beta two", "2.0", "http://e/b"), (None, "noversion", "http://e/d"), ("delta", "4.0", None)]
    assert [r[4] for r in got] == [None, None, "no name and version in the title", "no link; publication date not read"]
    assert got[0][3] == got[1][3].replace(hour=10)
    assert [row[4][:13] for _, row in feed.items(b"<rss>")] == ["feed not read"]


def test_two_polls_give_each_item_once(spark, tmp_path):
    source, out, done = tmp_path / "feed.xml", str(tmp_path / "out"), str(tmp_path / "done")
    poll = lambda: drain(spark, feed.feed(spark, str(source), str(tmp_path / "history")), out, done, ENTRY)
    source.write_text(rss(A, B))
    assert [r[0] for r in poll()] == ["alpha", "beta two"]
    source.write_text(rss(C, *BAD, B))
    assert [r[:2] for r in poll()] == [("alpha", "1.0"), ("beta two", "2.0"), ("delta", "4.0"), ("gamma", "3.0"), (None, "noversion")]
    assert len(poll()) == 5
    assert sorted(p.name for p in (tmp_path / "history").iterdir()) == ["000000000001.xml", "000000000002.xml"]
    assert feed.feed(spark, str(source), stream=False).count() == 4


@pytest.mark.parametrize("kept", [True, False])
def test_a_batch_that_is_run_again_has_the_same_items(tmp_path, kept):
    source = tmp_path / "feed.xml"
    reader = feed.FeedStream({"url": str(source), **({"history": str(tmp_path / "h")} if kept else {})})
    start = reader.initialOffset()
    source.write_text(rss(A, B))
    first, middle = reader.read(start)
    source.write_text(rss(B, C))
    second, end = reader.read(middle)
    first, second = list(first), list(second)
    source.write_text(rss(C, ("new 9", "http://e/n", "")))
    again = feed.FeedStream({"url": str(source), **({"history": str(tmp_path / "h")} if kept else {})})
    assert list(again.readBetweenOffsets(middle, end)) == second
    if kept:
        assert list(again.readBetweenOffsets(start, end)) == first + second
    assert reader.read(end)[0] is not None


def test_first_of_keys_with_restart_and_time_to_live(spark, tmp_path):
    schema, folder, out, done = "package_name string, version string, link string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "done")

    def run(rows, hours):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = state.start(state.first_of(spark.readStream.schema(schema).parquet(folder), ["package_name", "version"], hours), out, done, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted(r[:2] for r in map(tuple, spark.read.schema(schema).parquet(out).collect()) if r[0] == "a"), spark.read.schema(schema).parquet(out).count()

    assert run([("a", "1", "x"), ("a", "1", "y"), ("b", "1", "z"), (None, "1", "n")], 60 / 3600) == ([("a", "1")], 3)
    assert run([("a", "1", "again"), ("a", "2", "new"), (None, "1", "n")], 60 / 3600) == ([("a", "1"), ("a", "2")], 4)
    time.sleep(61)
    assert run([("a", "1", "later")], 60 / 3600) == ([("a", "1"), ("a", "1"), ("a", "2")], 5)
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_first_of_a_table(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "1"), (None, "1")], "package_name string, version string")
    assert state.new_packages(rows).count() == 2


def archive(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("src/a.py", text)
        z.writestr("tests/b.py", text)
    return out.getvalue()


def test_the_loop_over_a_feed(spark, tmp_path):
    bad = archive("import os, base64\nos.system(base64.b64decode('bHMgLWxh').decode())\n")
    contents = {"alpha": bad, "beta": archive("x = 1\n"), "gamma": None, "broken": b"no zip", "alpha2": bad}
    asked = spark.sparkContext.accumulator(0)

    def fetch(name, version, link):
        asked.add(1)
        if name == "down":
            raise OSError("no route")
        return None if contents[name] is None else (f"{name}-{version}.zip", contents[name])

    told, folder = [], str(tmp_path / "entries")
    row = lambda name, version, error=None: (name, version, "http://e", None, error)

    def run(*rows):
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(folder)
        running = packages.watch_feed(spark, spark.readStream.schema(ENTRY).parquet(folder), fetch, str(tmp_path / "sent"), str(tmp_path / "state"), notify=lambda new: told.extend(r.package_name for r in new.collect()), archive_folder=str(tmp_path / "archives"), keep=1, once=True)
        running.awaitTermination(240)
        assert all(q.exception() is None for q in running.queries)

    monkey = pytest.MonkeyPatch()
    monkey.setattr(alerts, "TOP_LEVEL_SCORE", 0.0)  # without a model all scores are 0
    try:
        run(row("alpha", "1"), row("beta", "1"), row("gamma", "1"), row("broken", "1"), row("down", "1"), row("x", "1", "bad item"))
        assert told == ["alpha"] and asked.value == 5
        assert [p.name for p in (tmp_path / "archives").iterdir()] == ["alpha-1.zip"]
        run(row("alpha", "1"), row("alpha", "2"), row("alpha2", "1"))
        # the path in an annotation names the version, so another version's finding is another alert
        assert sorted(told) == ["alpha", "alpha", "alpha2"] and asked.value == 7
        assert len(list((tmp_path / "archives").iterdir())) == 1
    finally:
        monkey.undo()
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert sorted((r.package_name, r.version) for r in sent.collect()) == [("alpha", "1"), ("alpha", "2"), ("alpha2", "1")]


def test_windowed_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    schema = "ts timestamp, kind string"
    at = lambda minutes, kind: (f"2024-01-01 {minutes // 60:02}:{minutes % 60:02}:00", kind)
    batches = [[at(m, "abc"[m % 3]) for m in range(0, 100)], [at(m, "a") for m in range(95, 300, 7)], [at(10, "late"), at(291, "b"), (None, "a")], [at(600, "end")]]
    frame = lambda rows: spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp").alias("ts"), "kind")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(folder)
        stream = state.windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "1 hour", "30 minutes", ["kind"])
        got = drain(spark, stream, out, str(tmp_path / "done"), "window_start timestamp, kind string, n long")
    whole = [r for rows in batches for r in rows if r[1] != "late"]
    wanted = state.windowed_counts(frame(whole), "1 hour", "30 minutes", ["kind"]).where("window_start < '2024-01-01 10:00:00'").collect()
    assert got == sorted(map(tuple, wanted), key=str)  # the late event is left out, the last window is still open
