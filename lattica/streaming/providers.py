"""Stream providers: where messages come from and go to.

A consumer is told when it starts (init), of every batch that was applied (acknowledge), of bad messages (handle_error)
and when it ends (shutdown); a producer of its start and end. Offsets are in the checkpoint of the running query, so
acknowledging matters only to services that drop what was acknowledged.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


class Consumer:
    #: Columns of the stream that order its messages, if it has any besides their place.
    arrival: list[str] | None = None

    def init(self, spark: SparkSession) -> None:
        """Before the first stream()."""

    def stream(self, spark: SparkSession) -> DataFrame:
        """A streaming frame with the column value, a message a row."""
        raise NotImplementedError

    def acknowledge(self, batch: int) -> None:
        """The batch is applied."""

    def handle_error(self, messages: DataFrame) -> None:
        """Messages (column raw) that could not be read; they are in the errors folder too."""

    def shutdown(self) -> None:
        """After the last stream() has stopped."""


class Producer:
    def init(self, spark: SparkSession) -> None:
        """Before the first publish()."""

    def publish(self, messages: DataFrame) -> None:
        """Send messages (column value)."""
        raise NotImplementedError

    def shutdown(self) -> None:
        """After the last publish()."""


class Publisher:
    """Sends the changes of a Database to producers: Database(spark, publish=Publisher(producers)). Events are numbered by
    change, and the tables in `skip` are not published."""

    def __init__(self, db: str, *producers: Producer, skip: frozenset[str] = frozenset()):
        self.db, self.producers, self.skip, self.count = db, producers, skip, 0

    def __call__(self, table: str, change) -> None:
        from pyspark.sql import functions as F

        from lattica.streaming.cdc import encode_change

        self.count += 1
        messages = None if table in self.skip else encode_change(change, self.db, table, sequence=[F.lit(time.time_ns() // 1_000_000), F.lit(self.count), F.monotonically_increasing_id()])
        for p in self.producers if messages is not None else ():
            p.publish(messages)


class Kafka(Consumer, Producer):
    """Offsets are in the query's checkpoint. Needs Spark's Kafka package on the class path."""

    arrival = ["timestamp", "partition", "offset"]

    def __init__(self, servers: str, topic: str, **options: str):
        self.servers, self.topic, self.options = servers, topic, options

    def read_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "subscribe": self.topic, "startingOffsets": "earliest"} | self.options

    def write_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic} | self.options

    def stream(self, spark):
        return spark.readStream.format("kafka").options(**self.read_options()).load().selectExpr("cast(value as string) as value", *self.arrival)

    def publish(self, messages):
        messages.selectExpr("cast(value as string) as value").write.format("kafka").options(**self.write_options()).save()


class Folder(Consumer, Producer):
    """Messages as lines of text files in a folder, the in-process queue. Files come in the order in which they were written,
    the lines of one file as they stand."""

    arrival = ["at", "file", "start"]

    def __init__(self, path: str, max_files: int = 1000):
        self.path, self.max_files = path, max_files

    def stream(self, spark):
        lines = spark.readStream.option("maxFilesPerTrigger", self.max_files).text(self.path)
        return lines.selectExpr("value", "_metadata.file_modification_time as at", "_metadata.file_name as file", "_metadata.file_block_start as start")

    def publish(self, messages):
        messages.select("value").write.mode("append").text(self.path)


class CallbackProducer(Producer):
    """Hands batches of messages to a function on the executors; max_batch messages a call."""

    def __init__(self, send: Callable[[list[str]], None], max_batch: int = 10):
        self.send, self.max_batch = send, max_batch

    def publish(self, messages):
        send, most = self.send, self.max_batch

        def part(rows):
            own = []
            for r in rows:
                own.append(r.value)
                if len(own) == most:
                    send(own)
                    own = []
            if own:
                send(own)

        messages.select("value").foreachPartition(part)


def _client(service: str, region: str):
    """Needs boto3 where it runs."""
    import boto3

    return boto3.client(service, region_name=region)


class _Shard(InputPartition):
    def __init__(self, shard: str, start: int, end: int):
        self.shard, self.start, self.end = shard, start, end


class _KinesisReader(DataSourceStreamReader):
    """Offsets are times of arrival in milliseconds, so a batch can be read again; each shard is read in a task of its own.
    A batch ends `settle` seconds ago: services give records their time a little late."""

    def __init__(self, client: Callable, stream: str, settle: float = 2.0):
        self.client, self.stream_name, self.settle = client, stream, settle

    def initialOffset(self) -> dict:
        return {"ms": 0}

    def latestOffset(self) -> dict:
        return {"ms": int((time.time() - self.settle) * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        client, out, more = self.client(), [], {"StreamName": self.stream_name}
        while more:
            got = client.list_shards(**more)
            out += [_Shard(s["ShardId"], start["ms"], end["ms"]) for s in got["Shards"]]
            more = {"NextToken": got["NextToken"]} if got.get("NextToken") else None
        return out

    def read(self, partition: _Shard) -> Iterator[tuple]:
        client = self.client()
        where = {"ShardIteratorType": "AT_TIMESTAMP", "Timestamp": partition.start / 1000} if partition.start else {"ShardIteratorType": "TRIM_HORIZON"}
        at = client.get_shard_iterator(StreamName=self.stream_name, ShardId=partition.shard, **where)["ShardIterator"]
        while at:
            got = client.get_records(ShardIterator=at, Limit=1000)
            for r in got["Records"]:
                ms = int(r["ApproximateArrivalTimestamp"].timestamp() * 1000)
                if ms >= partition.end:
                    return
                if ms >= partition.start:
                    yield r["Data"].decode(), partition.shard, f"{ms:020d}-{r['SequenceNumber'].zfill(64)}"
            if not got["Records"] and not got.get("MillisBehindLatest"):
                return
            at = got.get("NextShardIterator")


class _SqsReader(SimpleDataSourceStreamReader):
    """A queue has no offsets: an offset counts batches. Messages of a batch are kept until it is committed, then deleted from
    the queue; after a restart those not deleted come again, which the upserts of a keyed table make harmless."""

    def __init__(self, client: Callable, url: str, most: int = 1000):
        self.client, self.url, self.most, self.held = client, url, most, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        client, own = self.client(), []
        while len(own) < self.most:
            got = client.receive_message(QueueUrl=self.url, MaxNumberOfMessages=10, WaitTimeSeconds=0).get("Messages", [])
            if not got:
                break
            own += got
        if not own:
            return iter(()), start
        self.held[start["n"]] = own
        return iter([(m["Body"], self.url, str(i).zfill(64)) for i, m in enumerate(own)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(m["Body"], self.url, str(i).zfill(64)) for n in range(start["n"], end["n"]) for i, m in enumerate(self.held.get(n, []))])

    def commit(self, end: dict) -> None:
        client = self.client()
        for n in [n for n in self.held if n < end["n"]]:
            for m in self.held.pop(n):
                client.delete_message(QueueUrl=self.url, ReceiptHandle=m["ReceiptHandle"])


def queue_source(name: str, reader: Callable[[], DataSourceStreamReader | SimpleDataSourceStreamReader]) -> type[DataSource]:
    """A data source class of columns value, source and position over a reader; SimpleDataSourceStreamReader for services that one process reads."""

    class Queue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string, source string, position string"

    if isinstance(reader(), SimpleDataSourceStreamReader):
        Queue.simpleStreamReader = lambda self, schema: reader()
    else:
        Queue.streamReader = lambda self, schema: reader()
    return Queue


class _Queue(Consumer):
    arrival = ["position", "source"]

    def __init__(self, name: str, reader: Callable):
        self.name, self.reader = name, reader

    def init(self, spark):
        spark.dataSource.register(queue_source(self.name, self.reader))

    def stream(self, spark):
        return spark.readStream.format(self.name).load()


def kinesis_consumer(stream: str, region: str, client: Callable | None = None) -> Consumer:
    client = client or (lambda: _client("kinesis", region))
    return _Queue("kinesis_records", lambda: _KinesisReader(client, stream))


def sqs_consumer(url: str, region: str, client: Callable | None = None) -> Consumer:
    client = client or (lambda: _client("sqs", region))
    return _Queue("sqs_messages", lambda: _SqsReader(client, url))


def kinesis_producer(stream: str, region: str, client: Callable | None = None) -> CallbackProducer:
    client = client or (lambda: _client("kinesis", region))

    def send(batch: list[str]) -> None:
        from zlib import crc32

        client().put_records(StreamName=stream, Records=[{"Data": m.encode(), "PartitionKey": str(crc32(m.encode()))} for m in batch])

    return CallbackProducer(send, 100)


def sqs_producer(url: str, region: str, client: Callable | None = None) -> CallbackProducer:
    client = client or (lambda: _client("sqs", region))
    return CallbackProducer(lambda batch: client().send_message_batch(QueueUrl=url, Entries=[{"Id": str(i), "MessageBody": m} for i, m in enumerate(batch)]), 10)


class SearchIndex(Producer):
    """Change messages to the bulk API of a search server: rows are documents under the id that their key columns make.

    names: field names of the index for columns; columns without one are left out."""

    def __init__(self, url: str, index: str, key: list[str], names: dict[str, str] | None = None, max_batch: int = 500):
        self.url, self.index, self.key, self.names, self.max_batch = url.rstrip("/"), index, key, names, max_batch

    def lines(self, message: str) -> list[str]:
        """The bulk lines of a message's events."""
        out = []
        for event in json.loads(message).get("events", []):
            action = next((v for k, v in event.items() if k.endswith("action")), "").upper()
            before, after = event.get("before") or event.get("record") or {}, event.get("after") or event.get("record") or {}
            ident = lambda row: "-".join(str(row.get(k)) for k in self.key)
            if action == "DELETE" or action == "UPDATE" and ident(before) != ident(after):
                out.append(json.dumps({"delete": {"_index": self.index, "_id": ident(before)}}))
            if action in ("INSERT", "UPDATE"):
                row = {self.names[c] if self.names else c: v for c, v in after.items() if self.names is None or c in self.names}
                out += [json.dumps({"index": {"_index": self.index, "_id": ident(after)}}), json.dumps(row)]
        return out

    def publish(self, messages):
        lines, url = self.lines, self.url

        def send(batch: list[str]) -> None:
            body = "".join(f"{x}\n" for m in batch for x in lines(m)).encode()
            if body:
                request = urllib.request.Request(f"{url}/_bulk", body, {"Content-Type": "application/x-ndjson"})
                with urllib.request.urlopen(request, timeout=60) as answer:
                    if json.loads(answer.read() or b"{}").get("errors"):
                        raise OSError("the search server refused some documents")

        CallbackProducer(send, self.max_batch).publish(messages)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under a search index's field names; those without one are left out."""
    return rows.select(*(rows[c].alias(names[c]) for c in rows.columns if c in names))
