"""Interactions and feedback as a stream: restarts, replays, late and malformed lines."""

import json
import shutil

from docweave.streaming import feedback


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def line(kind, i, ts, of=None, rating=None):
    return {"type": kind, "id": i, "ts": f"2024-01-01 {ts}", "of": of, "rating": rating}


def take_in(spark, source, folder):
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(source)).withColumnRenamed("value", "line")
    feedback.run(stream, str(folder))
    rows = feedback.kept(spark, str(folder), "joined")
    return {r.id: (r.rating, r.n) for r in feedback.latest(rows).collect()}


def test_join_restart_and_replay(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    write(source, "0.txt", [line("interaction", 1, "10:00:00"), line("interaction", 2, "10:05:00"), "{broken", line("feedback", 11, "10:10:00", 1, 2.0), line("feedback", 11, "10:10:00", 1, 2.0)])
    assert take_in(spark, source, folder) == {1: (2.0, 1)}
    # The state of the first run goes on: an interaction of its files meets feedback of the next.
    write(source, "1.txt", [line("feedback", 12, "10:40:00", 2, 5.0), line("feedback", 13, "10:41:00", 1, 4.0), line("feedback", 14, "13:30:00", 2, 1.0), line("feedback", 15, "10:30:00", 99, 1.0), '{"type": "interaction"}'])
    assert take_in(spark, source, folder) == {1: (4.0, 2), 2: (5.0, 1)}
    assert sorted(r.line for r in feedback.kept(spark, str(folder), "malformed").collect()) == ['{"type": "interaction"}', "{broken"]
    # A batch whose number was not marked as done is done again, and replaces its rows.
    last = max((folder / "log-joined" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (folder / "log-joined" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    assert take_in(spark, source, folder) == {1: (4.0, 2), 2: (5.0, 1)}
    shutil.rmtree(folder)
    assert take_in(spark, source, folder) == {1: (4.0, 2), 2: (5.0, 1)}


def test_malformed(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", "[]", '{"type":"other","id":1,"ts":"2024-01-01 00:00:00"}', '{"type":"feedback","id":1,"ts":"soon"}', '{"type":"feedback","id":1,"ts":"2024-01-01 00:00:00.5"}')], "line string")
    good, bad = feedback.parsed(rows)
    assert good.count() == 1 and bad.count() == 5
