"""Chat-export text files as message rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text as tx
from ..operators.ordered import island_start, layout

# ---- fixed values ----
HEADER = (
    "^[\u200e\u200f\ufeff]*"
    r"\[?(\d{1,2})[./-](\d{1,2})[./-](\d{2,4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
    r"(?:\s*([AaPp])\.?\s?[Mm]\.?)?\]?\s*(?:-\s+)?(.*)$"
)
# line ends besides \n and \r that the source system recognises
LINE_BREAK = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# ---- end of fixed values ----


def read_chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line_no, line) of every text file below `folder`.

    Large files are read in splits. A line's number is made of where its split
    starts and its position in the task: a task holds at most one split's worth
    of bytes and a line at least one, so numbers rise along each file.
    """
    lines = spark.read.text(folder, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"), "value",
    )
    pieces = lines.select("path", "_start", "_at", F.posexplode(F.split("value", LINE_BREAK)).alias("_piece", "line"))
    return pieces.select(
        F.url_decode(F.regexp_replace(F.replace("path", F.lit("+"), F.lit("%2B")), r"^file:/*", "/")).alias("path"),
        ((F.col("_start") * 2 + F.col("_at")) * (1 << 20) + F.col("_piece")).alias("line_no"),
        "line",
    )


def parse_chats(
    lines: DataFrame, owner_names: list[str], day_first: bool = True, rows_per_block: int | None = None
) -> DataFrame:
    """Messages from (path, line_no, line).

    Entry headers open a message, other lines continue the entry before them;
    headers without "name: text" are system lines and open nothing. The date
    order is decided once for each file.
    """
    part = lambda i: F.regexp_extract("line", HEADER, i)
    number = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    is_header = F.col("line").rlike(HEADER)
    rest = F.when(is_header, tx.clean_chat(part(8))).otherwise("")
    rows = (
        lines.withColumns({"_header": is_header, "_rest": rest})
        .withColumn("_entry", F.col("_header") & F.contains("_rest", F.lit(": ")))
        .where(F.col("_entry") | ~(F.col("_header") & (F.col("_rest") != "")))  # system lines open nothing
        .where(F.col("_entry") | (tx.strip(F.col("line")) != ""))
    )
    lay = island_start(layout(rows, ["path"], ["line_no"], rows_per_block), F.col("_entry"), "_opened")
    rows = lay.done().where(F.col("_opened").isNotNull())
    colon = F.instr("_rest", ": ")
    piece = F.when(F.col("_entry"), F.substr(F.col("_rest"), colon + 2)).otherwise(F.col("line"))
    head = F.when(
        F.col("_entry"),
        F.struct(
            number(1).alias("d1"), number(2).alias("d2"), number(3).alias("yr"), number(4).alias("h"),
            number(5).alias("mi"), F.coalesce(number(6), F.lit(0)).alias("s"), F.lower(part(7)).alias("ampm"),
            tx.clean_chat(F.left("_rest", colon - 1)).alias("name"),
        ),
    )
    entries = rows.withColumns({"_piece": piece, "_head": head}).groupBy("path", F.col("_opened.line_no").alias("seq")).agg(
        F.max("_head").alias("h"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_piece"))), lambda x: x["_piece"]), "\n"
        ).alias("raw"),
    )
    # the date order needs the headers only: no second parse, and its size is left to the planner
    order = lines.where(is_header & F.contains(rest, F.lit(": "))).groupBy("path").agg(
        F.bool_or(number(1) > 12).alias("_first"), F.bool_or(number(2) > 12).alias("_second")
    ).select("path", F.when(F.col("_first"), True).when(F.col("_second"), False).otherwise(day_first).alias("_day_first"))
    h = F.col("h")
    day = F.when(F.col("_day_first"), h["d1"]).otherwise(h["d2"])
    month = F.when(F.col("_day_first"), h["d2"]).otherwise(h["d1"])
    year = F.when(h["yr"] < 100, h["yr"] + 2000).otherwise(h["yr"])
    hour = (
        F.when((h["ampm"] == "p") & (h["h"] != 12), h["h"] + 12)
        .when((h["ampm"] == "a") & (h["h"] == 12), 0)
        .otherwise(h["h"])
    )
    owners = [n.strip().lower() for n in owner_names]
    text = tx.clean_chat(F.col("raw"))
    seconds = F.when(h["s"] < 60, h["s"]).cast("double")  # no roll-over into the next minute
    return (
        entries.join(order, "path")  # one row for each file
        .withColumn("ts", F.try_make_timestamp(year, month, day, hour, h["mi"], seconds))
        .where(F.col("ts").isNotNull() & (text != "") & ~tx.is_deleted_text(F.col("raw")))
        .select(
            F.lit("whatsapp").alias("source"), paths.conversation_id(F.col("path")).alias("conversation_id"), "ts",
            F.col("seq").cast("long").alias("seq"),
            F.when(F.lower(h["name"]).isin(owners), "me").otherwise("other").alias("speaker"),
            h["name"].alias("speaker_name"), tx.message_text(F.col("raw")).alias("text"),
            F.lit(None).cast("string").alias("audio_ref"), F.lit(None).cast("string").alias("lang"),
            tx.is_media_text(F.col("raw")).alias("is_media"), "path",
        )
    )


def read_chats(spark: SparkSession, folder: str, owner_names: list[str], day_first: bool = True) -> DataFrame:
    return parse_chats(read_chat_lines(spark, folder), owner_names, day_first)
