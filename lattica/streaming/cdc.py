"""Change data capture: JSON change messages out of and into tables."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.dml import Change, _same

#: Before the names of a message's own fields, as opposed to columns; a parameter, since publishers have their own.
PREFIX = "_cdc_"


def _names(prefix: str) -> tuple[str, str, str, list[str]]:
    return f"{prefix}dbname", f"{prefix}tablename", f"{prefix}action", [f"{prefix}sequence{i}" for i in range(3)]


def _image(schema: T.StructType, at: str = "", more: list[Column] | None = None) -> Column:
    """A row as the message has it: binary in base64, times as text; null fields are left out by to_json."""
    out = []
    for f in schema:
        c = F.col(f"{at}{f.name}")
        if isinstance(f.dataType, T.BinaryType):
            c = F.base64(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return F.struct(*out, *(more or ()))


def encode(rows: DataFrame, db: str, table: str, action: str, prefix: str = PREFIX, sequence: list[Column] | None = None) -> DataFrame:
    """One message (column value) for every row. UPDATE takes rows of two structs, before and after: both images of a row
    side by side, so that no join pairs them and a change of the key is an update like any other.

    sequence: up to three numbers that order events, written into the bodies.
    """
    db_field, table_field, action_field, names = _names(prefix)
    head = [F.lit(db).alias(db_field), F.lit(table).alias(table_field), F.lit(action).alias(action_field)]
    order = [s.cast("long").alias(n) for s, n in zip(sequence or (), names)]
    if action.upper() == "UPDATE":
        bodies = [_image(rows.schema[n].dataType, f"{n}.", order).alias(n) for n in ("before", "after")]
    else:
        bodies = [_image(rows.schema, "", order).alias("record")]
    return rows.select(F.to_json(F.struct(F.array(F.struct(*head, *bodies)).alias("events"))).alias("value"))


def encode_change(change: Change, db: str, table: str, prefix: str = PREFIX, sequence: list[Column] | None = None) -> DataFrame | None:
    """The messages of a change of a table: none for a truncation. An upsert is sent as inserts, which are upserts to who applies them."""
    if change.action == "UPDATE":
        return encode(change.images, db, table, "UPDATE", prefix, sequence)
    if change.action == "DELETE":
        return encode(change.before, db, table, "DELETE", prefix, sequence)
    return encode(change.after, db, table, "INSERT", prefix, sequence) if change.after is not None else None


def _typed(image: Column, schema: T.StructType) -> Column:
    out = []
    for f in schema:
        c = image[f.name]
        c = F.unbase64(c) if isinstance(f.dataType, T.BinaryType) else F.when(c.isNotNull(), c.try_cast(f.dataType))
        out.append(c.alias(f.name))
    return F.struct(*out)


def decode(messages: DataFrame, schema: T.StructType, value: str = "value", prefix: str = PREFIX, arrival: list[str] | None = None) -> DataFrame:
    """(db, table, action, seq, before, after, bad, raw): an event a row. Actions in any case, bodies nested or flat.

    bad is set for messages without events, with an unknown action or without a body. seq orders events: the three
    sequence numbers (0 where a message has none), then the columns `arrival` of the messages, such as a topic's
    partition and offset (else their place in the frame), then the place in the message.
    """
    db_field, table_field, action_field, sequence = _names(prefix)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField(s, T.LongType()) for s in sequence])
    event = T.StructType([T.StructField(n, T.StringType()) for n in (db_field, table_field, action_field)] + [T.StructField(n, text) for n in ("record", "before", "after")] + text.fields)
    came = F.struct(*(arrival or ()), F.monotonically_increasing_id().alias("place"))
    parsed = messages.select(F.col(value).cast("string").alias("raw"), came.alias("came"), F.from_json(F.col(value).cast("string"), T.StructType([T.StructField("events", T.ArrayType(event))]), {"mode": "PERMISSIVE"}).alias("m"))
    each = parsed.select("raw", "came", F.posexplode_outer("m.events").alias("pos", "e"))
    flat = F.struct(*(F.col("e")[f.name].alias(f.name) for f in text))
    filled = F.greatest(*(F.col("e")[f.name].isNotNull() for f in schema)) if len(schema) > 1 else F.col("e")[schema[0].name].isNotNull()
    record = F.coalesce(F.col("e.record"), F.when(filled, flat))
    action = F.upper(F.col(f"e.{action_field}"))
    before = F.when(action == "UPDATE", F.col("e.before")).when(action == "DELETE", record)
    after = F.when(action == "UPDATE", F.col("e.after")).when(action == "INSERT", record)
    known = F.coalesce(action.isin("INSERT", "UPDATE", "DELETE"), F.lit(False)) & ((action == "INSERT") | before.isNotNull()) & ((action == "DELETE") | after.isNotNull())
    numbers = [F.coalesce(after[s], before[s], F.lit(0)).alias(f"s{i}") for i, s in enumerate(sequence)]
    seq = F.struct(*numbers, F.col("came"), F.coalesce("pos", F.lit(0)).alias("pos"))
    return each.select(F.col(f"e.{db_field}").alias("db"), F.col(f"e.{table_field}").alias("table"), action.alias("action"), seq.alias("seq"), F.when(before.isNotNull(), _typed(before, schema)).alias("before"), F.when(after.isNotNull(), _typed(after, schema)).alias("after"), (~F.coalesce(known, F.lit(False))).alias("bad"), "raw")


def fold(events: DataFrame, key: list[str]) -> DataFrame:
    """The last event of every key, in sequence; an update that changes the key is a delete of the old and an insert of the new."""
    moved = F.lit(False)
    for k in key:
        moved |= ~F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}"))
    moved &= F.col("action") == "UPDATE"
    after_type = events.schema["after"].dataType
    rest = F.struct("action", F.lit(1).alias("step"), "before", "after")
    gone = F.struct(F.lit("DELETE").alias("action"), F.lit(0).alias("step"), "before", F.lit(None).cast(after_type).alias("after"))
    each = events.select("seq", F.inline(F.when(moved, F.array(gone, rest)).otherwise(F.array(rest))))
    each = each.withColumn("k", F.struct(*(F.coalesce(F.col(f"after.{k}"), F.col(f"before.{k}")).alias(k) for k in key)))
    last = each.groupBy("k").agg(F.max_by(F.struct("action", "after"), F.struct("seq", "step")).alias("e"))
    return last.select("k", "e.action", "e.after")


def apply(table: DataFrame, events: DataFrame, key: list[str] | None) -> DataFrame:
    """The table after the events. With a key: the last event of every key decides. Without, see apply_keyless()."""
    good = events.filter(~F.col("bad"))
    if not key:
        return apply_keyless(table, good)
    last = fold(good, key)
    kept = table.alias("a").join(last.select("k.*").alias("b"), _same(key), "left_anti")
    return kept.unionByName(last.filter("action <> 'DELETE'").select("after.*").select(*table.columns))


def apply_keyless(table: DataFrame, good: DataFrame) -> DataFrame:
    """Events in sequence on a table without a key: an insert adds a row, an update or delete acts on all rows that are then
    equal to its before image in the columns that the image has. An image without any value acts on none.

    Images are grouped by which columns they have, and each group meets the rows in one equal join of these columns; a row
    gets the events of its image and takes the first one after it came to be. What was updated goes round again, on its own,
    until nothing finds an event: as often as updates follow each other on one row in the batch.
    """
    columns = table.columns
    spark = table.sparkSession
    images = good.filter("before IS NOT NULL").withColumn("has", F.concat(*(F.when(F.col(f"before.{c}").isNull(), "0").otherwise("1") for c in columns))).filter(F.col("has").contains("1"))
    kinds = [r.has for r in images.select("has").distinct().orderBy("has").collect()]  # which columns images have: few shapes
    grouped = []
    for i, has in enumerate(kinds):
        on = [c for c, h in zip(columns, has) if h == "1"]
        own = images.filter(F.col("has") == has).groupBy(*(F.col(f"before.{c}").alias(f"_on{j}") for j, c in enumerate(on)))
        grouped.append((on, own.agg(F.collect_list(F.struct("seq", "action", "after")).alias(f"_events{i}"))))
    born_type = good.schema["seq"].dataType
    live = table.select(F.struct(*columns).alias("row"), F.lit(None).cast(born_type).alias("born"))
    live = live.unionByName(good.filter("action = 'INSERT'").select(F.struct(*(F.col(f"after.{c}").alias(c) for c in columns)).alias("row"), F.col("seq").alias("born")))
    if not kinds:
        return live.select("row.*")
    out = None
    while True:
        hit = live
        for i, (on, own) in enumerate(grouped):
            match = F.lit(True)
            for j, c in enumerate(on):
                match &= F.col(f"row.{c}") == F.col(f"_on{j}")
            hit = hit.join(own, match, "left").drop(*(f"_on{j}" for j in range(len(on))))
        found = F.concat(*(F.coalesce(F.filter(f"_events{i}", lambda e: F.col("born").isNull() | (e["seq"] > F.col("born"))), F.array().cast(own.schema[f"_events{i}"].dataType)) for i, (_, own) in enumerate(grouped)))
        # by its place in the sequence alone: after images need no order
        order = F.array_min(F.transform(found, lambda e: e["seq"]))
        hit = hit.withColumn("_all", found).withColumn("_next", order).select("row", "born", F.get(F.filter("_all", lambda e: e["seq"] == F.col("_next")), F.lit(0)).alias("event"))
        still = hit.filter("event IS NULL").select("row.*")
        out = still if out is None else out.unionByName(still)
        live = hit.filter("event.action = 'UPDATE'").select(F.struct(*(F.col(f"event.after.{c}").alias(c) for c in columns)).alias("row"), F.col("event.seq").alias("born"))
        live = live.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else live.persist()
        if live.isEmpty():
            return out


def dead_letters(events: DataFrame) -> DataFrame:
    return events.filter("bad").select("raw")


class VersionedTable:
    """A table as folders of Parquet, in buckets of its key, and a manifest for every version: which folder has each bucket.

    A batch writes the version of its number from the one before, and only the buckets that its events touch; applying a
    batch again writes the same again. Without a key, batches of inserts add folders, and others write the table anew.
    vacuum() drops folders that the last versions do not use."""

    def __init__(self, spark, path: str, schema: T.StructType, key: list[str] | None, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets if key else 1
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _fs(self):
        return self._hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, root = self._fs(), self._hadoop.Path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, below: int | None = None) -> dict[int, list[str]]:
        """Bucket to its folders, of the last version (below a number)."""
        own = [v for v in self.versions() if below is None or v < below]
        if not own:
            return {}
        stream = self._fs().open(self._hadoop.Path(f"{self.path}/manifests/{own[-1]}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folders for b, folders in json.loads(text).items()}

    def read(self, below: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        folders = sorted({f"{self.path}/{f}" for b, own in self.manifest(below).items() if buckets is None or b in buckets for f in own})
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def bucket(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _publish(self, manifest: dict[int, list[str]], version: int) -> None:
        """A version counts from the moment its manifest has its name."""
        fs, at = self._fs(), self._hadoop.Path(f"{self.path}/manifests/{version}.json")
        part = self._hadoop.Path(f"{self.path}/manifests/.{version}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(at):
            fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"cannot publish version {version} of {self.path}")

    def write(self, df: DataFrame, version: int, manifest: dict[int, list[str]] | None = None) -> None:
        """df as the rows of its buckets; other buckets are those of the manifest given."""
        name = f"v={version}-{uuid.uuid4().hex}"
        keyed = df.withColumn("_bucket", self.bucket(*map(F.col, self.key)) if self.key else F.lit(0))
        if self.key:
            keyed = keyed.repartition("_bucket")
        keyed.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        fs, root = self._fs(), self._hadoop.Path(f"{self.path}/{name}")
        own = [s.getPath().getName() for s in fs.listStatus(root)]
        new = {int(n.partition("=")[2]): [f"{name}/{n}"] for n in own if n.startswith("_bucket=")}
        self._publish({**(manifest or {}), **new}, version)

    def apply(self, events: DataFrame, version: int) -> None:
        old = self.manifest(below=version)
        good = events.filter(~F.col("bad"))
        if not self.key:
            if good.filter("action <> 'INSERT'").isEmpty():
                before = old.get(0, [])
                self.write(good.select("after.*"), version)
                self._publish({0: before + self.manifest(version + 1).get(0, [])}, version)
            else:
                self.write(apply(self.read(below=version), events, None), version)
            return
        images = [self.bucket(*(F.col(f"{side}.{k}") for k in self.key)) for side in ("before", "after")]
        touched = {r[0] for r in good.select(F.explode(F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), b) for s, b in zip(("before", "after"), images)))))).distinct().collect()}
        self.write(apply(self.read(below=version, buckets=touched), events, self.key), version, {b: f for b, f in old.items() if b not in touched})

    def vacuum(self, keep: int = 2) -> int:
        """Drop manifests but for the last `keep`, and the folders that none of those name; returns how many folders went."""
        fs, own = self._fs(), self.versions()
        used = {f.partition("/")[0] for v in own[-keep:] for folders in self.manifest(v + 1).values() for f in folders}
        for v in own[:-keep]:
            fs.delete(self._hadoop.Path(f"{self.path}/manifests/{v}.json"), False)
        gone = [s.getPath() for s in fs.listStatus(self._hadoop.Path(self.path)) if s.getPath().getName().startswith("v=") and s.getPath().getName() not in used]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def rotate(spark, errors: str, hours: int = 6, now: datetime | None = None) -> None:
    """Drop the hours of dead letters that are older."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(errors)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    least = ((now or datetime.now(UTC)) - timedelta(hours=hours)).strftime("%Y-%m-%d-%H")
    for s in fs.listStatus(root) if fs.exists(root) else ():
        if s.getPath().getName().startswith("hour=") and s.getPath().getName()[5:] < least:
            fs.delete(s.getPath(), True)


def run_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, errors: str | None = None, trigger: dict | None = None, provider=None, arrival: list[str] | None = None, keep: int = 2):
    """Apply a stream of messages (column value) to the table; bad ones go to the errors folder, by hour, kept for six.

    provider: told of every batch that is applied (acknowledge), and of bad messages (handle_error). Returns the running
    query: stop() stops it, starting again resumes from the checkpoint.
    """

    def batch(df: DataFrame, n: int) -> None:
        # what is kept for the steps to read again holds the text of bad messages only: of good ones it is more than their rows
        events = decode(df, table.schema, arrival=arrival).withColumn("raw", F.when(F.col("bad"), F.col("raw"))).persist()
        try:
            table.apply(events, n)
            table.vacuum(keep)
            bad = dead_letters(events)
            if errors:
                bad.write.mode("overwrite").text(f"{errors}/hour={datetime.now(UTC):%Y-%m-%d-%H}/batch={n}")
                rotate(table.spark, errors)
            if provider is not None:
                provider.handle_error(bad)
                provider.acknowledge(n)
        finally:
            events.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Streams:
    """Running consumers by name: start, stop, pause and resume, each from where its checkpoint is."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self._known, self._running = spark, folder.rstrip("/"), {}, {}

    def start(self, name: str, provider, table: VersionedTable, trigger: dict | None = None) -> None:
        if name in self._running and self._running[name].isActive:
            raise ValueError(f"consumer {name} is running")
        provider.init(self.spark)
        self._known[name] = (provider, table, trigger)
        self._running[name] = run_stream(provider.stream(self.spark), table, f"{self.folder}/{name}/checkpoint", f"{self.folder}/{name}/errors", trigger, provider, getattr(provider, "arrival", None))

    def pause(self, name: str) -> None:
        """Stop reading; the provider stays as it is."""
        self._running[name].stop()

    def resume(self, name: str) -> None:
        provider, table, trigger = self._known[name]
        self._running[name] = run_stream(provider.stream(self.spark), table, f"{self.folder}/{name}/checkpoint", f"{self.folder}/{name}/errors", trigger, provider, getattr(provider, "arrival", None))

    def stop(self, name: str) -> None:
        self.pause(name)
        self._known.pop(name)[0].shutdown()
        del self._running[name]

    def wait(self, name: str) -> None:
        self._running[name].awaitTermination()

    def status(self) -> dict[str, str]:
        return {n: "running" if q.isActive else "paused" for n, q in self._running.items()}
