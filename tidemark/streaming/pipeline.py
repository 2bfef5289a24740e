"""The same decisions from a stream of payments.

Payments become one row per entity key, and one for the payment itself. Keyed
state holds each key's recent history; rows wait in it until the watermark has
passed them and are then taken in order of (dt, id), so that a stream gives what
a batch gives whatever the order of arrival within the watermark's delay. The
rows of a payment come out in one batch and meet again by its id; score and
rules are the columns that batches use. A stream may start from a batch's
payments.

Exactly-once output, restart and moving state between executors are
Structured Streaming's own: offsets and state are checkpointed together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tidemark.catalog import ENTITIES, IDLE_TTL, SHARED, WINDOWS
from tidemark.functions.values import milli
from tidemark.operators.velocity import keys
from tidemark.session import session_like
from tidemark.shipping import ship
from tidemark.streaming.keyed import _OFFSET, ANSWER, BASE, HEARTBEAT, PART, PER_KEY, AnswerProcessor, JoinProcessor, VelocityProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch writes what it changed, not a copy of each store's files.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
#: How long rows wait for earlier ones. Sources may lag each other by this much.
DELAY = "10 minutes"

#: Groups that an entity's keys are dealt to; it stays the same for a checkpoint's life.
SHARDS = 32


def _keyed(payments: DataFrame) -> list[Column]:
    """Per entity a struct (entity, key) that is null where a payment has no key."""
    return [F.when(F.col("id").isNotNull() & keys(e)[0].isNotNull(), F.struct(F.lit(e).alias("entity"), F.concat_ws("|", *[k.cast("string") for k in keys(e)]).alias("key"))) for e in ENTITIES]


def routed(payments: DataFrame, delay: str = DELAY, shards: int = SHARDS) -> DataFrame:
    """One row for each key that a payment has, and one (BASE) with the payment itself, under a watermark. Rows without id (heartbeats) only move the watermark.

    The time itself isn't passed on: operators drop rows whose time is behind the watermark, and late ones must stay.
    """
    named = _keyed(payments)
    beat = F.struct(F.lit(HEARTBEAT).alias("entity"), F.lit("").alias("key"))
    base = F.struct(F.lit(BASE).alias("entity"), F.col("id").cast("string").alias("key"))
    expected = F.size(F.filter(F.array(*named), lambda x: x.isNotNull()))
    payload = F.when(F.col("_k.entity") == BASE, F.to_json(F.struct(*payments.columns)))
    df = payments.withColumn("ts", F.timestamp_seconds(F.col("dt") + _OFFSET)).withWatermark("ts", delay)
    df = df.withColumns({"expected": expected, "_k": F.explode(F.when(F.col("id").isNull(), F.array(beat)).otherwise(F.array_append(F.filter(F.array(*named), lambda x: x.isNotNull()), base)))})
    shard = F.pmod(F.xxhash64("_k.key"), F.lit(shards)).cast("int")
    return df.select("_k.entity", shard.alias("shard"), "_k.key", "id", "dt", "amount", milli(F.col("amount")).alias("milli"), F.col("card1").alias("card"), "expected", payload.alias("payload"))


def history_state(payments: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows from which a stream that follows these payments starts: each key's last week, with when its history began and how many rows its group has."""
    df = payments.withColumn("_k", F.explode(F.filter(F.array(*_keyed(payments)), lambda x: x.isNotNull())))
    df = df.select("_k.entity", F.pmod(F.xxhash64("_k.key"), F.lit(shards)).cast("int").alias("shard"), "_k.key", "id", "dt", milli(F.col("amount")).alias("milli"), F.col("card1").alias("card"))
    of = W.partitionBy("entity", "shard", "key")
    df = df.withColumn("_gap", F.col("dt") - F.lag("dt").over(of.orderBy("dt", "id")))
    df = df.withColumns({"began": F.max(F.when(F.col("_gap").isNull() | (F.col("_gap") >= IDLE_TTL), F.col("dt"))).over(of), "_last": F.max("dt").over(of)})
    df = df.filter(F.col("dt") > F.col("_last") - max(WINDOWS.values())).drop("_gap", "_last")
    return df.withColumn("rows", F.count("*").over(W.partitionBy("entity", "shard")))


def velocity_parts(payments: DataFrame, delay: str = DELAY, ordered: bool = True, shards: int = SHARDS, history: DataFrame | None = None) -> DataFrame:
    """Rows of PART: (id, entity, late, features) for each key of each payment, once the watermark has passed it, and the payment itself.

    history: payments of a batch, all before the stream's, whose keys' histories the stream goes on with.
    """
    ship(payments.sparkSession)
    grouped = routed(payments, delay, shards).groupBy("entity", "shard")
    before = None if history is None else history_state(history, shards).groupBy("entity", "shard")
    return grouped.transformWithStateInPandas(VelocityProcessor(ordered), PART, "Append", "EventTime", before)


def joined_features(payments: DataFrame, parts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Payments with the features of all their parts: payments is the stream that parts was made from."""
    out = StructType([StructField("id", LongType()), StructField("payload", StringType()), StructField("late", BooleanType()), *[StructField(f"{e}_{c}", DoubleType()) for e in ENTITIES for c in PER_KEY]])
    rows = parts.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").transformWithStateInPandas(JoinProcessor(), out, "Append", "None")
    schema = StructType([f for f in payments.schema if f.name not in ("id",)])
    rows = rows.withColumn("_p", F.from_json("payload", schema)).select("id", "_p.*", "late", *[c for c in out.names[3:]])
    for e in SHARED:
        rows = rows.withColumnRenamed(f"{e}_distinct_cards", f"distinct_cards_per_{e}_24h")
    return rows.drop(*[f"{e}_distinct_cards" for e in ENTITIES])


def live_features(payments: DataFrame, delay: str = DELAY, shards: int = SHARDS, history: DataFrame | None = None) -> DataFrame:
    """Payments with all features and whether one was late. history: a batch's payments before them."""
    return joined_features(payments, velocity_parts(payments, delay, shards=shards, history=history), shards)


def once(events: DataFrame, key: str, ts: str = "ts", within: str = "4 days") -> DataFrame:
    """The first delivery of each key within the time: for webhook events, idempotency keys and resent payments."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


#: How long a request's answer is kept, and of how many keys a shard keeps them.
ANSWER_TTL, ANSWER_CAPACITY = 86_400, 1 << 20


def answered(requests: DataFrame, ttl: int = ANSWER_TTL, capacity: int = ANSWER_CAPACITY, shards: int = SHARDS) -> DataFrame:
    """(key, at, status, answer) of a stream of requests (key, body, at in seconds, answer): whether each is its key's first, the same again, or another one.

    The same again gets the first one's answer. Requests without key are told apart by time and body.
    Forgetting a key, by age or as one too many, only lets a later request count as a first.
    """
    ship(requests.sparkSession)
    loose = F.concat(F.lit("\0"), F.coalesce(F.col("at").cast("string"), F.lit("")), F.lit("\0"), F.sha2(F.coalesce("body", F.lit("")), 256))
    named = F.coalesce(F.nullif("key", F.lit("")), loose)
    df = requests.select(named.alias("key"), F.coalesce("at", F.lit(0)).cast("bigint").alias("at"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("digest"), F.col("answer").cast("string").alias("answer"))
    df = df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    out = df.groupBy("shard").transformWithStateInPandas(AnswerProcessor(ttl, capacity), ANSWER, "Append", "None")
    return out.withColumn("key", F.when(~F.startswith("key", F.lit("\0")), F.col("key")))


def key_conflicts(requests: DataFrame, key: str = "idempotency_key", body: str = "body") -> DataFrame:
    """(key, requests, bodies) of keys that came with more than one body."""
    digest = F.sha2(F.col(body), 256)
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.count_distinct(digest).alias("bodies")).filter("bodies > 1")


def start(df: DataFrame, path: str, checkpoint: str, decide: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Write the stream's rows, decided, as JSON lines; each batch's files appear together and once."""
    df = decide(df) if decide else df
    writer = df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def split_dead_letters(decoded: DataFrame, good_path: str, dead_path: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """Good records and dead letters of a decoded stream, each to its own place. A batch done again overwrites its own folders."""

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("error IS NULL").drop("error", column).write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        batch.filter("error IS NOT NULL").select(column, "error").write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
        batch.unpersist()

    return decoded.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_labels(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Dispute states kept up to date by a stream of events: each batch writes the next version from the last.

    Versions are numbered by batch, so a batch that is done again reads the same version and writes the same one.
    """
    from tidemark.operators.labels import dispute_states, upsert

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            states = upsert(spark.read.parquet(f"{path}/v{number - 1}"), batch)
        else:
            states = dispute_states(batch)
        states.write.mode("overwrite").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """A topic's records, to its present end if not a stream. Needs the Kafka connector on the class path; data loss fails the query."""
    reader = spark.readStream if stream else spark.read
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "true"}
    return reader.format("kafka").options(**options).load().selectExpr("CAST(value AS STRING) AS value", "partition", "offset", "timestamp")


def kafka_records(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(key, value) of rows as JSON, and of `partitions` the one that the key's MD5 number gives: the same for every writer."""
    name = F.col(key).cast("string")
    out = [name.alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")]
    if partitions:
        number = F.conv(F.substring(F.md5(F.coalesce(name, F.lit(""))), 1, 8), 16, 10).cast("bigint")
        out.append((number % partitions).cast("int").alias("partition"))
    return df.select(*out)


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str, partitions: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Write a stream's rows to a topic, acknowledged by all replicas. A batch done again sends its rows again: readers use once(). Needs the Kafka connector."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "checkpointLocation": checkpoint}
    writer = kafka_records(df, key, partitions).writeStream.format("kafka").options(**options).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def configure(spark: SparkSession) -> None:
    """Settings that stateful processors need."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def session(spark: SparkSession, shards: int = SHARDS) -> SparkSession:
    """A session for streams: spark's own settings, with those that stateful processors need.

    State is in as many partitions as tasks run at once, and in no more than there are shards: each one costs
    a worker, a store to open and files to write in every batch, whatever it holds.
    """
    parts = "spark.sql.shuffle.partitions"
    most = min(int(spark.conf.get(parts)), shards, spark.sparkContext.defaultParallelism)
    return session_like(spark, SETTINGS | {parts: max(1, most)})


def state_summary(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(entity, keys) of a stopped query's key histories, and ("waiting", keys) of payments that still wait for parts, read from its checkpoint."""
    found = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorProperties").distinct().collect()
    out = None
    for p in found:
        heads = '"heads"' in p.operatorProperties
        one = spark.read.format("statestore").option("operatorId", p.operatorId).option("stateVarName", "heads" if heads else "parts").load(checkpoint)
        keys_ = F.sum("user_map_value.n") if heads else F.count("*")
        one = one.groupBy((F.col("key.entity") if heads else F.lit("waiting")).alias("entity")).agg(keys_.alias("keys"))
        out = one if out is None else out.unionByName(one)
    return out


def replay(payments: DataFrame, path: str, batches: int, beats: bool = True) -> None:
    """Payments as JSON files in order of time, one per batch, for a file source; each ends with a heartbeat if beats."""
    low, high = payments.agg(F.min("dt"), F.max("dt")).first()
    if low is None:
        return
    step = (high - low) // batches + 1
    for b in range(batches):
        part = payments.filter((F.col("dt") >= low + b * step) & (F.col("dt") < low + (b + 1) * step))
        if beats:
            beat = payments.sparkSession.createDataFrame([(low + (b + 1) * step - 1,)], "dt bigint")
            part = part.unionByName(beat, allowMissingColumns=True)
        part.orderBy("dt", "id").coalesce(1).write.mode("append").json(path)
