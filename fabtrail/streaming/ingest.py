"""Live messages: the same expressions as for files, in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fabtrail.functions import entries as E
from fabtrail.functions.sniff import admit
from fabtrail.functions.text import stem
from fabtrail.operators.filters import latest, live_view
from fabtrail.operators.ordering import occurrence_number
from fabtrail.operators.tables import LogStore
from fabtrail.plans.ingest import run_timestamp, warning
from fabtrail.plans.normalise import normalise_entries
from fabtrail.schema import DEFAULT_LIMITS, LOGS
from fabtrail.session import barrier, conformed, stored
from fabtrail.sources.structured import object_texts

UNKNOWN_TOPIC_TOOL = "MQTT_UNKNOWN"


def topic_tool(topic: Column) -> Column:
    """Tool named by the last part of a topic of at least three parts."""
    parts = F.split(topic, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(F.lit(UNKNOWN_TOPIC_TOOL))


def with_source(messages: DataFrame) -> DataFrame:
    """``(topic, payload)`` messages with the topic's tool, a file name and the payload as text."""
    tool = topic_tool(F.col("topic"))
    return messages.withColumns(
        {
            "topic_tool": tool,
            "source_filename": F.concat(F.lit("mqtt_"), tool, F.lit(".json")),
            "source_format": F.lit("json"),
            "content": F.make_valid_utf8(F.col("payload").cast("binary").cast("string")),
        }
    ).withColumn("admitted", admit(F.col("source_filename"), F.col("payload")))


def opened(messages: DataFrame) -> DataFrame:
    """Messages with their source and, in the place of the payload, the texts of their ``objects``; null where not admitted.

    Made to be stored where both the records and the warnings of messages are wanted.
    """
    sourced = barrier(with_source(messages))
    objects = F.when(F.col("admitted"), object_texts(F.col("content")))
    return sourced.withColumn("objects", objects).drop("payload", "content")


def message_records(messages: DataFrame) -> DataFrame:
    """One row of ``entries`` per object in an admitted message."""
    made = ("payload", "content", "objects", "admitted", "row", "topic_tool", "source_filename", "source_format")
    kept = [c for c in messages.columns if c not in made]
    is_open = "objects" in messages.columns
    parsed = (
        (messages if is_open else with_source(messages))
        .where("admitted")
        .select(
            *kept,
            "topic_tool",
            "source_filename",
            "source_format",
            F.posexplode("objects" if is_open else object_texts(F.col("content"))).alias("row", "_object"),
        )
        .withColumn("row", F.col("row").cast("bigint"))
        .withColumn("entries", E.json_entries(F.col("_object")))
        .drop("_object")
    )
    return barrier(parsed).where(F.col("entries").isNotNull())


def overridden_tool(tool: Column, source_filename: Column, topic: Column) -> Column:
    """The topic's tool wherever the record named none."""
    defaulted = tool.isin("UNKNOWN", "UNKNOWN_TOOL") | (tool == source_filename) | (
        tool == stem(source_filename)
    )
    return F.when(defaulted, topic).otherwise(tool)


def message_logs(messages: DataFrame, ingest_ts: str) -> DataFrame:
    """Log rows of messages; works on batch and streaming frames alike.

    A column ``message_key`` that is unique per message makes ids that survive a replay.
    """
    records = message_records(messages)
    if "message_key" in messages.columns:
        # the key travels as the id until the position in the message is added
        records = records.withColumn(
            "id", F.sha2(F.concat_ws("/", F.col("message_key"), F.col("row").cast("string")), 256)
        )
    # the topic's tool is a function of the file name, so it needs no column of its own
    logs = normalise_entries(records, ingest_ts)
    name = F.col("source_filename")
    topic = F.regexp_extract(name, r"^mqtt_(.*)\.json$", 1)
    return logs.withColumn("tool_id", overridden_tool(F.col("tool_id"), name, topic))


def message_warnings(messages: DataFrame) -> DataFrame:
    """Messages the guard rejects, and messages without a record."""
    sourced = messages if "objects" in messages.columns else opened(messages)
    # an object whose members can be read
    found = F.exists("objects", lambda o: F.from_json(o, "map<string,string>").isNotNull())
    text = F.when(
        ~F.col("admitted"), F.concat(F.lit("Invalid file format: "), F.col("source_filename"))
    ).when(~F.coalesce(found, F.lit(False)), F.concat(F.lit("No records extracted from "), F.col("topic")))
    told = barrier(sourced.withColumn("_text", text))
    return warning(told.where(F.col("_text").isNotNull()), F.col("_text"))


def _keyed(batch: DataFrame, batch_id: int) -> DataFrame:
    """Messages with a key that is the same when the batch is run again."""
    if {"partition", "offset"} <= set(batch.columns):
        key = F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
        return batch.withColumn("message_key", key)
    numbered = occurrence_number(batch.select("topic", "payload"), ["topic", "payload"], "_copy")
    key = F.concat_ws(
        "/", F.lit(str(batch_id)), F.col("topic"), F.sha2("payload", 256), F.col("_copy").cast("string")
    )
    return numbered.withColumn("message_key", key).drop("_copy")


def stream_ingest(
    source: DataFrame,
    store: LogStore,
    checkpoint: str,
    *,
    ingest_ts: str | None = None,
    available_now: bool = False,
    interval: str = "2 seconds",
    mine: bool = False,
    pack_every: int = 100,
) -> StreamingQuery:
    """Append a stream of ``(topic, payload)`` messages to the log table; with ``mine`` with the clusters of their messages.

    After every ``pack_every`` batches the small files they have left are packed together (0: never).

    Every batch is written at least once; ids do not change when a batch is run again, and
    rows whose id is stored are left out, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = [c for c in ("topic", "payload", "partition", "offset") if c in batch.columns]
        # the guard and the search for objects run once, for the records and the warnings
        messages = stored(opened(_keyed(stored(batch.select(*kept), "batch"), batch_id)), "messages")
        # ids come from the message's topic, which names the file
        rows = message_logs(messages, ingest_ts or run_timestamp())
        store.append_logs(store.with_templates(stored(rows, "parsed")) if mine else rows, within_files=True)
        notes = message_warnings(messages).withColumn("batch_id", F.lit(batch_id))
        # a batch that runs again replaces its own warnings
        notes.write.mode("overwrite").parquet(f"{store.root}/stream_warnings/batch={batch_id}")
        if pack_every and (batch_id + 1) % pack_every == 0:
            for table in ("logs", "recipes"):
                store.pack_files(table)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def hourly_volume_stream(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows per hour and severity of a stream of log rows, closed when the watermark passes."""
    timed = logs.withColumn("_time", F.col("event_ts").cast("timestamp")).withWatermark("_time", late)
    return (
        timed.groupBy(F.window("_time", "1 hour"), "severity")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "severity", "count")
    )


def distinct_messages(messages: DataFrame, late: str = "1 hour", time: str = "timestamp") -> DataFrame:
    """Messages of a stream, each once: those that repeat topic, place and payload within ``late`` are left out.

    The state holds a hash for each message of the last ``late`` only; nothing stored is read.
    """
    place = [c for c in ("partition", "offset") if c in messages.columns]
    key = F.sha2(F.concat_ws("/", "topic", *[F.col(c).cast("string") for c in place], F.sha2("payload", 256)), 256)
    return (
        messages.withColumn("message_hash", key)
        .withWatermark(time, late)
        .dropDuplicatesWithinWatermark(["message_hash"])
        .drop("message_hash")
    )


class LiveView:
    """The live view of a stream of log rows, kept up to date batch by batch.

    What is kept is the view itself, ``limit`` rows, so neither the state nor the work of a batch grows with the history. A batch makes
    a new version from the version of the batch before it; one that runs again makes the same version again.
    """

    def __init__(self, spark: SparkSession, path: str, limit: int = DEFAULT_LIMITS["live"]):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), limit

    def _folder(self, number: int) -> str:
        return f"{self.path}/batch={number}"

    def _done(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        numbers = [int(s.getPath().getName().split("=")[1]) for s in system.listStatus(root)]
        success = lambda n: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(n)}/_SUCCESS")
        return sorted(n for n in numbers if system.exists(success(n)))

    def _rows(self, before: int | None = None) -> DataFrame:
        done = [n for n in self._done() if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], LOGS)
        return self.spark.read.schema(LOGS).parquet(self._folder(done[-1]))

    def read(self) -> DataFrame:
        return live_view(self._rows(), self.limit)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col("source_filename").startswith("mqtt_")).select(*conformed(batch, LOGS))
        newest = latest(self._rows(batch_id).unionByName(new), self.limit)
        newest.write.mode("overwrite").parquet(self._folder(batch_id))
        for older in self._done()[:-2]:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(older))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def start(self, logs: DataFrame, checkpoint: str, available_now: bool = False, interval: str = "2 seconds") -> StreamingQuery:
        writer = logs.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
        return writer.start()
