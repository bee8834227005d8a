"""The given tables seen as archive tables (messages, turns, segments, memories...)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table; times without a zone are taken as session time (UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table whose rows each get costly work."""
    return spread(table(spark, folder, name))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """`conversations` as the message table."""
    return as_messages(table(spark, folder, "conversations"))


def as_messages(conversations: DataFrame) -> DataFrame:
    """Assistant is the owner, system rows go."""
    c = conversations.where("role <> 'system'")
    pick = F.col("conv_id") % 4
    return c.select(
        F.when(pick == 0, "whatsapp").when(pick == 1, "call").when(pick == 2, "voice_note").otherwise("video").alias("source"),
        F.concat(F.lit("chat:"), F.col("conv_id").cast("string")).alias("conversation_id"),
        F.timestamp_micros(
            F.lit(1704067200000000) + (F.col("conv_id") % 3650) * 86400000000 + F.col("turn") * 60000000
        ).alias("ts"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "me").otherwise("other").alias("speaker"),
        F.when(F.col("role") == "assistant", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("guest"), (F.col("conv_id") % 7).cast("string")))
        .alias("speaker_name"),
        F.col("text"),
    )


def event_turns(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as one conversation for each user: bursts of the same speaker occur."""
    return as_event_turns(table(spark, folder, "events"))


def as_event_turns(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("event").alias("source"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("conversation_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click"), "me").otherwise("other").alias("speaker"),
        F.col("event_type").alias("speaker_name"),
        F.concat_ws(" ", F.col("event_type"), F.col("props")).alias("text"),
    )


def document_turns(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` as one conversation for each source, owner and counterpart taking
    turns: this is where exact copies occur."""
    return table(spark, folder, "documents").select(
        F.lit("document").alias("source"),
        F.concat(F.lit("doc:"), F.col("source")).alias("conversation_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
        F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 3 == 2, "me").otherwise("other").alias("speaker"),
        F.col("source").alias("speaker_name"),
        F.col("text"),
        F.col("lang"),
    )



def segments(spark: SparkSession, folder: str) -> DataFrame:
    """View and click events as transcript segments, `value` minutes long, in ms."""
    e = table(spark, folder, "events").where("event_type in ('view', 'click')")
    return e.select(
        F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("audio_ref"),
        F.col("event_id").alias("segment_id"),
        F.unix_millis("ts").alias("start_ms"),
        (F.unix_millis("ts") + F.round(F.col("value") * 60000).cast("long")).alias("end_ms"),
        F.col("event_type").alias("speaker"),
        F.col("props").alias("text"),
    )


def diarized_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The other events as diarized intervals, in ms."""
    e = table(spark, folder, "events").where("event_type not in ('view', 'click')")
    return e.select(
        F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("audio_ref"),
        F.col("event_id").alias("turn_id"),
        F.unix_millis("ts").alias("start_ms"),
        (F.unix_millis("ts") + F.round(F.col("value") * 60000).cast("long")).alias("end_ms"),
        F.col("event_type").alias("label"),
    )


def moods(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as mood readings; the score is value / 500."""
    return as_moods(table(spark, folder, "events"))


def as_moods(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "view", "neutral")
        .when(F.col("event_type") == "click", "happy")
        .when(F.col("event_type") == "purchase", "surprised")
        .when(F.col("event_type") == "signup", "tired")
        .otherwise("stressed")
        .alias("mood"),
        (F.col("value") / 500).alias("score"),
    )


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """`documents` with vectors as the memory table (documents without one keep NULL)."""
    d = texts(spark, folder, "documents")
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    kind = F.col("doc_id") % 5
    trust = F.col("doc_id") % 3
    return d.join(v, "doc_id", "left").select(
        F.col("doc_id").alias("memory_id"),
        F.col("vector"),
        F.col("text"),
        F.when(kind == 0, "episodic").when(kind == 1, "fact").when(kind == 2, "diary").when(kind == 3, "photo").otherwise("forward").alias("kind"),
        F.col("source"),
        F.timestamp_seconds(F.lit(1483228800) + (F.col("doc_id") % 3000) * 86400).alias("ts"),
        F.concat(F.lit("doc:"), F.col("source")).alias("conversation_id"),
        F.concat(F.lit("guest"), (F.col("doc_id") % 9).cast("string")).alias("counterpart"),
        F.when(trust == 0, "public").when(trust == 1, "personal").otherwise("secret").alias("trust"),
    )


def photos(spark: SparkSession, folder: str) -> DataFrame:
    """`orders` as a photo table: customer folders, dated and undated pictures."""
    o = table(spark, folder, "orders")
    source = F.col("o_orderkey") % 4
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.lit("/archive/"), F.col("o_orderpriority"), F.lit("/cust"), F.col("o_custkey").cast("string"),
            F.lit("/IMG_"), F.col("o_orderkey").cast("string"), F.lit(".jpg"),
        ).alias("path"),
        F.col("o_orderdate").cast("timestamp").alias("taken_at"),
        F.when(source == 0, "exif").when(source == 1, "filename").when(source == 2, "exif_modified").otherwise("mtime").alias("date_source"),
        (F.col("o_orderkey") % 4).cast("int").alias("rank"),
        F.col("o_totalprice"),
        F.col("o_orderstatus"),
    )
