"""The queue as a stream that is stopped and started again, against one pass over all its rows."""

import random
from datetime import datetime, timedelta

import pytest

from linewise.streaming import queue

SCHEMA = "queue string, at timestamp, seq long, kind string, work string, instruction string"


def plain_pass(rows):
    """Events by the rules in words: one runs, others wait in order of first request."""
    running, waiting, out = {}, {}, []
    for q, at, _, kind, work, text in rows:
        own, text = waiting.setdefault(q, []), (text or "").strip()
        if kind == "ask":
            match = [x for x in own if x[0] == work]
            if q not in running:
                running[q] = (work, text)
                out.append((q, at, "started", work, text))
            elif match:
                if text:
                    match[0][1] = text
                out.append((q, at, "updated" if text else "repeated", work, match[0][1]))
            elif running[q][0] == work:
                out.append((q, at, "repeated", *running[q]))
            else:
                own.append([work, text])
                out.append((q, at, "queued", work, text))
        elif kind == "remove":
            out += [(q, at, "removed", *x) for x in own if x[0] == work]
            waiting[q] = [x for x in own if x[0] != work]
        elif q in running and running[q][0] == work:
            out.append((q, at, kind, *running.pop(q)))
            if own:
                running[q] = tuple(own.pop(0))
                out.append((q, at, "started", *running[q]))
    return out


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, queue.PROVIDER)
    yield spark
    spark.conf.set(key, old)


def run(spark, folder, where, **options):
    events = queue.queue_events(spark.readStream.schema(SCHEMA).json(str(folder)), **options)
    query = events.writeStream.format("parquet").option("path", str(where / "out")).option("checkpointLocation", str(where / "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


def rows_of(n, queues, seed):
    r, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=r.choice([0, 1, 30]))
        kind = r.choice(["ask", "ask", "ask", "done", "error", "remove"])
        rows.append((r.choice(queues), at, i, kind, r.choice("abcd"), r.choice(["", None, " softer ", "longer", "again"])))
    return rows


def test_a_queue_goes_on_where_it_was_stopped(store, tmp_path):
    rows = rows_of(240, ["hot", "hot", "x", "y"], 1)
    want = plain_pass(rows)
    for a, b in ((0, 70), (70, 71), (71, 240)):  # three runs of the stream, from one checkpoint
        put(store, rows[a:b], tmp_path / "in")
        run(store, tmp_path / "in", tmp_path, limit=10**6)
    got = [tuple(x) for x in store.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(want) and {x[2] for x in want} == {"started", "queued", "updated", "repeated", "removed", "done", "error"}


def test_what_runs_too_long_makes_way(store, tmp_path):
    t = datetime(2024, 1, 1)
    put(store, [("q", t, 0, "ask", "a", "x"), ("q", t + timedelta(seconds=5), 1, "ask", "b", None)], tmp_path / "in")
    run(store, tmp_path / "in", tmp_path, late="1 second", limit=60)
    put(store, [("other", t + timedelta(hours=1), 2, "ask", "c", None)], tmp_path / "in")  # time goes on
    run(store, tmp_path / "in", tmp_path, late="1 second", limit=60)
    run(store, tmp_path / "in", tmp_path, late="1 second", limit=60)
    got = sorted((x.event, x.work) for x in store.read.parquet(str(tmp_path / "out")).filter("queue = 'q'").collect())
    assert ("timeout", "a") in got and ("started", "b") in got


def test_steps_by_hand():
    q = queue.Queue()
    step = lambda *a: [e[:2] + (e[2],) for e in q.step(*a)]
    assert step("ask", "a", "") == [("started", "a", "")] and step("ask", "b", "one") == [("queued", "b", "one")] and step("ask", "c", "") == [("queued", "c", "")]
    assert step("ask", "b", "two") == [("updated", "b", "two")] and step("ask", "b", "") == [("repeated", "b", "two")] and step("ask", "a", "z") == [("repeated", "a", "")]
    assert step("done", "b", "") == [] and step("done", "a", "") == [("done", "a", ""), ("started", "b", "two")]
    assert step("remove", "c", "") == [("removed", "c", "")] and step("stopped", "b", "") == [("stopped", "b", "two")] and q.running is None
