"""Change messages, their order, tables of versions, and providers with stand-ins for their services."""

import http.server
import json
import threading
import time
from datetime import UTC, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lattica.operators import dml
from lattica.sources.bulk_import import Import, read_jdbc
from lattica.sources.catalog import Database
from lattica.streaming import cdc, providers

SCHEMA = "id long, name string"


def messages(spark, *events):
    lines = [json.dumps({"events": e if isinstance(e, list) else [e]}) for e in events]
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string").coalesce(1)


def event(action, **body):
    return {"_cdc_dbname": "d", "_cdc_tablename": "t", "_cdc_action": action, **body}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fixed_messages_in_order(spark):
    """Nested and flat bodies, any case, a moved key, and events of one key that only their place orders."""
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA)
    got = messages(
        spark,
        event("insert", id=4, name="d"),
        [event("UPDATE", before={"id": 1, "name": "a"}, after={"id": 10, "name": "a2"}), event("delete", record={"id": 2})],
        event("INSERT", record={"id": 2, "name": "again"}),
        [event("UPDATE", before={"id": 10, "name": "a2"}, after={"id": 11, "name": "a3"}), event("DELETE", record={"id": 4, "name": "d"})],
        event("MERGE", record={"id": 7}),
        event("INSERT"),
    )
    events = cdc.decode(got, table.schema, arrival=["n"])
    assert rows(cdc.apply(table, events, ["id"])) == [(11, "a3"), (2, "again"), (3, "c")]
    assert cdc.dead_letters(events).count() == 2
    # sequence numbers outweigh the place
    late = messages(spark, event("INSERT", record={"id": 1, "name": "new", "_cdc_sequence0": 2}), event("INSERT", record={"id": 1, "name": "old", "_cdc_sequence0": 1}))
    assert rows(cdc.apply(table.filter("id = 1"), cdc.decode(late, table.schema), ["id"])) == [(1, "new")]


def test_keyless_in_sequence(spark):
    table = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], SCHEMA)
    got = messages(
        spark,
        event("UPDATE", before={"id": 1, "name": "a"}, after={"id": 1, "name": "b"}),
        event("INSERT", record={"id": 9, "name": "b"}),
        event("DELETE", record={"id": 3}),
        event("INSERT", record={"id": 3, "name": "later"}),
        event("UPDATE", before={"name": "b"}, after={"id": 5, "name": "z"}),
        event("INSERT", record={"id": 1, "name": "a"}),
        event("DELETE", record={"name": None}),
    )
    events = cdc.decode(got, table.schema, arrival=["n"])
    assert rows(cdc.apply(table, events, None)) == [(1, "a"), (2, None), (3, "later"), (5, "z"), (5, "z"), (5, "z")]
    plan = cdc.apply(table, events, None)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert rows(cdc.apply(table, events.filter("action = 'INSERT'"), None)) == rows(table.unionByName(spark.createDataFrame([(9, "b"), (3, "later"), (1, "a")], SCHEMA)))


def test_messages_carry_every_type(spark):
    e = spark.sql("select 1L id, 'ä\"' t, X'00ff' b, timestamp'2001-02-03 04:05:06.789' ts, date'2001-02-03' d, cast(1.5 as decimal(5,2)) n, true f, cast(null as string) z")
    back = cdc.decode(cdc.encode(e, "d", "t", "INSERT", sequence=[F.lit(7), F.lit(8)]), e.schema)
    assert rows(back.select("after.*")) == rows(e) and tuple(back.select("seq.s0", "seq.s1", "seq.s2").first()) == (7, 8, 0)
    value = cdc.encode(e, "d", "t", "INSERT").first().value
    assert '"z"' not in value and json.loads(value)["events"][0]["record"]["b"] == "AP8="


def test_versions(spark, tmp_path):
    table = cdc.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["id"], buckets=8)
    schema = table.schema
    assert table.read().count() == 0
    table.apply(cdc.decode(messages(spark, *[event("INSERT", record={"id": i, "name": "a"}) for i in range(40)]), schema), 0)
    first = table.manifest()
    table.apply(cdc.decode(messages(spark, event("UPDATE", before={"id": 3, "name": "a"}, after={"id": 3, "name": "b"}), event("DELETE", record={"id": 4})), schema), 1)
    second = table.manifest()
    changed = {b for b in first if first[b] != second.get(b)}
    assert 1 <= len(changed) <= 2 and table.read().count() == 39 and table.read().filter("name = 'b'").count() == 1
    # the same batch again, after it was written: the same table
    table.apply(cdc.decode(messages(spark, event("UPDATE", before={"id": 3, "name": "a"}, after={"id": 3, "name": "b"}), event("DELETE", record={"id": 4})), schema), 1)
    assert table.read().count() == 39 and table.read(below=1).count() == 40
    assert table.vacuum(keep=1) >= 1 and table.versions() == [1] and table.read().count() == 39
    table.apply(cdc.decode(messages(spark, "not an event"), schema), 2)
    assert table.read().count() == 39
    keyless = cdc.VersionedTable(spark, f"file://{tmp_path}/k", schema, None)
    for n in range(2):
        keyless.apply(cdc.decode(messages(spark, event("INSERT", record={"id": n, "name": "x"})), schema), n)
    assert len(keyless.manifest()[0]) == 2 and rows(keyless.read()) == [(0, "x"), (1, "x")]
    keyless.apply(cdc.decode(messages(spark, event("DELETE", record={"id": 1})), schema), 2)
    assert rows(keyless.read()) == [(0, "x")]


def test_stream_keeps_only_bad_texts(spark, tmp_path):
    """The events that a batch keeps have no texts of good messages; bad ones have theirs whole."""
    kept = []

    class Seen(cdc.VersionedTable):
        def apply(self, events, version):
            kept.extend(tuple(r) for r in events.select("bad", "raw").collect())
            super().apply(events, version)

    queue = providers.Folder(f"file://{tmp_path}/queue")
    bad = ["broken", json.dumps({"events": [event("INSERT", id=9), event("MERGE", record={"id": 7})]})]
    queue.publish(messages(spark, *[event("INSERT", record={"id": i, "name": "a"}) for i in range(5)]).select("value").union(spark.createDataFrame([(b,) for b in bad], "value string")))
    table = Seen(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["id"])
    cdc.run_stream(queue.stream(spark), table, f"file://{tmp_path}/checkpoint", f"file://{tmp_path}/errors", arrival=queue.arrival).awaitTermination()
    assert sorted(kept, key=repr) == sorted([(False, None)] * 6 + [(True, b) for b in bad], key=repr)
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/errors").select("value").collect()) == sorted(bad)
    assert rows(table.read()) == [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "a"), (9, None)]


class Told(providers.Folder):
    def __init__(self, path):
        super().__init__(path)
        self.calls = []

    def init(self, spark):
        self.calls.append("init")

    def acknowledge(self, batch):
        self.calls.append(f"batch {batch}")

    def handle_error(self, bad):
        self.calls.append(f"{bad.count()} bad")

    def shutdown(self):
        self.calls.append("shutdown")


def test_streams_life_cycle(spark, tmp_path):
    queue, streams = Told(str(tmp_path / "q")), cdc.Streams(spark, f"file://{tmp_path}/s")
    table = cdc.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["id"])
    queue.publish(messages(spark, event("INSERT", record={"id": 1, "name": "a"}), "broken"))
    streams.start("one", queue, table)
    streams.wait("one")
    streams.pause("one")
    assert streams.status() == {"one": "paused"} and table.read().count() == 1
    queue.publish(messages(spark, event("INSERT", record={"id": 2, "name": "b"})))
    streams.resume("one")
    streams.wait("one")
    streams.stop("one")
    assert queue.calls == ["init", "1 bad", "batch 0", "0 bad", "batch 1", "shutdown"] and table.read().count() == 2
    hours = [p.name for p in (tmp_path / "s/one/errors").iterdir()]
    assert hours and all(h.startswith("hour=") for h in hours)
    cdc.rotate(spark, f"file://{tmp_path}/s/one/errors", now=datetime(2100, 1, 1, tzinfo=UTC))
    assert not list((tmp_path / "s/one/errors").iterdir())


def test_publishing_of_changes(spark, tmp_path):
    queue = providers.Folder(str(tmp_path / "q"))
    db = Database(spark, publish=providers.Publisher("d", queue, skip=frozenset(["hidden"])))
    for text in ("create table t (id bigint primary key, name varchar(9))", "create table hidden (id bigint)", "insert into hidden values (1)", "insert into t values (1, 'a'), (2, 'b')", "begin", "insert into t values (8, 'x')", "rollback", "update t set id = id + 10 where name = 'b'", "begin", "delete from t where id = 1", "commit"):
        db.execute(text)
    events = cdc.decode(spark.read.text(queue.path), db["t"].schema)
    assert rows(cdc.apply(spark.createDataFrame([], db["t"].schema), events, ["id"])) == rows(db["t"]) == [(12, "b")]
    assert events.count() == 4


def kinesis(path):
    """A stand-in made where it is used: workers do not import tests."""

    class Kinesis:
        """A folder of shards, each a list of (sequence number, time, text)."""

        def __init__(self, path):
            self.path = Path(path)

        def list_shards(self, StreamName=None, NextToken=None):
            names = sorted(p.stem for p in self.path.glob("*.json"))
            return {"Shards": [{"ShardId": n} for n in names[:1]], "NextToken": "more"} if NextToken is None else {"Shards": [{"ShardId": n} for n in names[1:]]}

        def get_shard_iterator(self, StreamName, ShardId, ShardIteratorType, Timestamp=0):
            return {"ShardIterator": f"{ShardId}|{0}|{Timestamp}"}

        def get_records(self, ShardIterator, Limit):
            shard, at, since = ShardIterator.split("|")
            own = [r for r in json.loads((self.path / f"{shard}.json").read_text()) if r[1] >= float(since)]
            part = own[int(at) : int(at) + 2]
            return {"Records": [{"SequenceNumber": n, "ApproximateArrivalTimestamp": datetime.fromtimestamp(t, UTC), "Data": d.encode()} for n, t, d in part], "MillisBehindLatest": 0, "NextShardIterator": f"{shard}|{int(at) + 2}|{since}"}

    return lambda: Kinesis(path)


class Sqs:
    """A folder of messages, a file each."""

    def __init__(self, path):
        self.path = Path(path)

    def receive_message(self, QueueUrl, MaxNumberOfMessages, WaitTimeSeconds):
        held = self.path / "held"
        held.mkdir(exist_ok=True)
        own = sorted(p for p in self.path.glob("*.txt"))[:MaxNumberOfMessages]
        return {"Messages": [{"Body": p.rename(held / p.name).read_text(), "ReceiptHandle": p.name} for p in own]}

    def delete_message(self, QueueUrl, ReceiptHandle):
        (self.path / "held" / ReceiptHandle).unlink()


def test_kinesis_records(spark, tmp_path):
    for s in range(2):
        (tmp_path / f"shard{s}.json").write_text(json.dumps([[str(100 + i), 1000 + i, json.dumps({"events": [event("INSERT", record={"id": s * 10 + i, "name": "k"})]})] for i in range(5)]))
    path, table = str(tmp_path), cdc.VersionedTable(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["id"])
    source, streams = providers.kinesis_consumer("s", "here", kinesis(path)), cdc.Streams(spark, f"file://{tmp_path}/c")
    streams.start("k", source, table, {"processingTime": "1 second"})
    for _ in range(60):
        if table.read().count() == 10:
            break
        time.sleep(0.5)
    failed = streams._running["k"].exception()
    streams.stop("k")
    assert failed is None, failed
    assert rows(table.read().select("id")) == sorted([(s * 10 + i,) for s in range(2) for i in range(5)], key=repr)
    reader = providers._KinesisReader(kinesis(path), "s")
    assert [r[2][-3:] for r in reader.read(providers._Shard("shard0", 1_001_000, 1_003_000))] == ["101", "102"]


def test_sqs_messages(tmp_path):
    for i in range(23):
        (tmp_path / f"{i:03}.txt").write_text(f"m{i}")
    reader = providers._SqsReader(lambda: Sqs(tmp_path), "url", most=15)
    start = reader.initialOffset()
    first, end = reader.read(start)
    assert len(list(first)) == 20 and [x[0] for x in reader.readBetweenOffsets(start, end)][:2] == ["m0", "m1"]
    second, last = reader.read(end)
    assert len(list(second)) == 3 and reader.read(last)[1] == last
    reader.commit(end)
    assert len(list((tmp_path / "held").iterdir())) == 3 and not list(reader.readBetweenOffsets(start, end))
    reader.commit(last)
    assert not list((tmp_path / "held").iterdir())


def test_search_index(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"errors": false}')

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        index = providers.SearchIndex(f"http://127.0.0.1:{server.server_port}", "people", ["id"], {"id": "key", "name": "full_name"})
        index.publish(messages(spark, event("INSERT", record={"id": 1, "name": "a", "more": 5}), [event("UPDATE", before={"id": 2}, after={"id": 3, "name": "c"}), event("DELETE", record={"id": 4})]))
    finally:
        server.shutdown()
    lines = [json.loads(x) for path, body in seen for x in body.splitlines() if path == "/_bulk"]
    assert lines == [{"index": {"_index": "people", "_id": "1"}}, {"key": 1, "full_name": "a"}, {"delete": {"_index": "people", "_id": "2"}}, {"index": {"_index": "people", "_id": "3"}}, {"key": 3, "full_name": "c"}, {"delete": {"_index": "people", "_id": "4"}}]


def test_kafka_options(spark):
    k = providers.Kafka("h:1", "topic", startingOffsets="latest")
    assert k.read_options() == {"kafka.bootstrap.servers": "h:1", "subscribe": "topic", "startingOffsets": "latest"} and k.write_options()["topic"] == "topic"


def test_callback_batches(spark, tmp_path):
    path = str(tmp_path)

    def send(batch):
        import uuid

        Path(path, uuid.uuid4().hex).write_text(json.dumps(batch))

    providers.CallbackProducer(send, 4).publish(messages(spark, *[event("INSERT", record={"id": i}) for i in range(10)]))
    assert sorted(len(json.loads(p.read_text())) for p in tmp_path.iterdir()) == [2, 4, 4]


def test_jdbc_import(spark, tmp_path):
    """From a database in this process: split by key ranges, without a key, with a filter, an empty table; then stored with progress."""
    url = "jdbc:derby:memory:import;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id", "cast(id % 7 as string) as name").write.format("jdbc").options(url=url, dbtable="src", driver=driver).save()
    spark.range(0).selectExpr("id").write.format("jdbc").options(url=url, dbtable="empty_src", driver=driver).save()
    split = read_jdbc(spark, url, "src", driver, key="id", parts=5)
    assert split.rdd.getNumPartitions() == 5 and split.count() == 100 and split.selectExpr("sum(id)").first()[0] == 4950
    whole = read_jdbc(spark, url, "src", driver, where='"id" >= 90')
    assert whole.rdd.getNumPartitions() == 1 and whole.count() == 10
    assert read_jdbc(spark, url, "empty_src", driver, key="id").count() == 0
    job = Import(spark, "jdbc")
    job.run(split, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100 and job.progress()[0] == job.progress()[1] >= 5


def test_import_cancelled(spark, tmp_path):
    job, errors = Import(spark, "slow"), []
    slow = spark.range(0, 40, 1, 40).select(F.udf(lambda i: time.sleep(0.5) or i, "long")("id").alias("id"))

    def run():
        try:
            job.run(slow, str(tmp_path / "out"))
        except Exception as e:
            errors.append(e)

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        if job.progress()[1]:
            break
        time.sleep(0.1)
    job.cancel()
    t.join(60)
    assert not t.is_alive() and errors
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "out")).count()


def test_batch_statuses(spark):
    table = spark.createDataFrame([(1, "a")], SCHEMA)
    new = spark.createDataFrame([(1, "x", 0), (2, "y", 2), (2, "first", 1), (None, "n", 3), (None, "m", 4), (3, "z", 5)], "id long, name string, o int")
    change, marked = dml.batch_insert(table, new, ["id"], order=F.col("o"))
    assert sorted(((r.name, r.status) for r in marked.collect())) == [("first", -2), ("m", -100), ("n", -2), ("x", -100), ("y", -100), ("z", -2)]
    assert change.table.count() == 4
    up = dml.upsert(table, new, ["id"], order=F.col("o")).table
    assert rows(up) == [(1, "x"), (2, "y"), (3, "z"), (None, "m")]
