"""Slots and queues as streams: late failures free slots, projects run one at a time."""

import time

from corpusloom.streaming import admission

EVENTS = "project string, no long, source_id string, group string, event string"


def fed(spark, tmp_path, schema, batches, make, pause=0.0):
    """Runs a stream batch by batch over the same state; returns the rows of each batch."""
    source, seen, state = str(tmp_path / "in"), [], str(tmp_path / "state")

    def keep(batch, number):
        seen.append([tuple(r) for r in batch.collect()])

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        before = len(seen)
        stream = spark.readStream.schema(schema).parquet(source)
        make(stream).writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        seen[before:] = [sum(seen[before:], [])]
        time.sleep(pause)
    return seen


def test_a_late_failure_frees_a_slot(spark, tmp_path):
    batches = [
        [("p", 1, "a", "g", "asks"), ("p", 2, "b", None, "asks"), ("p", 3, "c", " ", "asks"), ("p", 4, "d", "g", "asks"), ("p", 5, "e", "h", "asks"), ("q", 1, "a", None, "asks")],
        [("p", 6, "a", None, "fails"), ("p", 7, "f", "h", "asks"), ("p", 8, "b", None, "ends")],
        [("p", 9, "d", None, "fails"), ("p", 10, "a", "g", "asks")],
        [("p", 11, "c", None, "fails"), ("p", 12, "b", None, "asks")],
        [("p", 13, "e", None, "fails"), ("p", 14, "f", None, "fails")],
    ]
    got = fed(spark, tmp_path, EVENTS, batches, lambda s: admission.stream_slots(s, 2))
    assert set(got[0]) == {("p", "a", 1, "admitted"), ("p", "b", 2, "admitted"), ("p", "c", None, "waits"), ("p", "d", 1, "admitted"), ("p", "e", None, "waits"), ("q", "a", 1, "admitted")}
    assert got[1] == [("p", "a", 1, "left"), ("p", "f", None, "waits"), ("p", "b", 2, "done")]  # the group still has d
    assert got[2] == [("p", "d", 1, "left"), ("p", "c", 1, "admitted"), ("p", "a", None, "waits")]  # who waited longest
    assert got[3] == [("p", "c", 1, "left"), ("p", "e", 1, "admitted"), ("p", "f", 1, "admitted")]  # b is in already
    assert got[4] == [("p", "e", 1, "left"), ("p", "f", 1, "left"), ("p", "a", 1, "admitted")]


def test_the_silent_leave(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    batches = [[("p", 1, "a", None, "asks"), ("p", 2, "b", None, "asks")], [("q", 1, "z", None, "asks")]]
    got = fed(spark, tmp_path, EVENTS, batches, lambda s: admission.stream_slots(s, 1, patience_ms=1), pause=1.0)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got[0][:2] == [("p", "a", 1, "admitted"), ("p", "b", None, "waits")]
    later = [r for r in sum(got, [])[2:] if r[0] == "p"]
    assert later[:2] == [("p", "a", 1, "left"), ("p", "b", 1, "admitted")]


def test_one_project_at_a_time(spark, tmp_path):
    schema = "queue string, no long, project string, item string, event string"
    batches = [
        [("q", 1, "x", "1", "asks"), ("q", 2, "y", "1", "asks"), ("q", 3, "z", "1", "asks"), ("q", 4, "y", "2", "asks")],
        [("q", 5, "x", "2", "asks"), ("q", 6, "y", "1", "ends")],
        [("q", 7, "x", "1", "ends")],
        [("q", 8, "y", "1", "ends")],
        [("q", 9, "y", "2", "ends"), ("q", 10, "z", "1", "ends")],
    ]
    got = fed(spark, tmp_path, schema, batches, admission.stream_queue)
    assert got == [[("q", "x", "1", 1)], [], [("q", "y", "1", 1), ("q", "y", "2", 2)], [], [("q", "z", "1", 1), ("q", "x", "2", 1)]]


def test_the_queue_is_not_searched_for_each_request(spark, tmp_path, monkeypatch):
    calls = []

    class Map:
        def __init__(self):
            self.rows = {}

        def containsKey(self, key):
            return key in self.rows

        def getValue(self, key):
            return self.rows[key]

        def updateValue(self, key, value):
            self.rows[key] = value

        def removeKey(self, key):
            del self.rows[key]

        def iterator(self):
            for row in list(self.rows.items()):
                calls.append(row)
                yield row

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        def getMapState(self, *_):
            return Map()

        def getValueState(self, *_):
            return Value()

    import pandas as pd

    asks = [(i, f"s{i}", f"g{i % 40}", "asks") for i in range(400)]
    # a freed slot goes to the first of the queue that is still there, and to its whole group
    late = [(400, "s2", None, "fails"), *((401 + k, f"s{40 * k}", None, "fails") for k in range(10))]
    slots = admission.Slots(2)
    slots.init(Handle())
    told = pd.concat(list(slots.handleInputRows(("p",), iter([pd.DataFrame(asks, columns=["no", "source_id", "group", "event"])]), None)))
    assert list(told["event"]).count("admitted") == 20 and list(told["event"]).count("waits") == 380
    assert len(calls) < 400  # 75,000 and more when each request went through the queue
    told = pd.concat(list(slots.handleInputRows(("p",), iter([pd.DataFrame(late, columns=["no", "source_id", "group", "event"])]), None)))
    assert [r for r in told[told["event"] == "admitted"][["source_id", "slot"]].itertuples(index=False, name=None)] == [(f"s{40 * k + 3}", 1) for k in range(10)]
