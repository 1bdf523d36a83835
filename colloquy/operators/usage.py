"""Token usage, rolled up without double counting and without hiding what is not known."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.columns import day
from colloquy.schema import CANONICAL

DIMENSIONS = ("model", "day", "conversation", "source")
COUNTS = ("messages", "messages_without_usage", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def window_start(window: str | None, now_ms: int) -> int | None:
    """The first millisecond of a window such as 30d that ends now."""
    if window is None:
        return None
    m = re.fullmatch(r"([0-9]+)d", window)
    if not m:
        raise ValueError(f"invalid window {window!r}: expected days, for example 30d")
    return now_ms - int(m[1]) * 86_400_000


def usage(messages: DataFrame, by: str = "model", since: int | None = None) -> DataFrame:
    """One row a key, ascending: messages (with usage) and those without, token sums, duplicates_skipped.

    messages has conversation_id, source, message_id, role, ts_ms, model, usage, file_ord, conversation_ord and seq. The
    first copy of a (conversation, message) in input order counts; each later copy adds one to duplicates_skipped of
    its own key. Only messages from since on (inclusive) take part. reasoning_tokens and reasoning_messages are null
    where no message of the key reports reasoning. The key column is named key.
    """
    return _rolled(_marked(messages, by, since)).orderBy("key")


_IDS = ("conversation_id", "message_id")


def _marked(messages: DataFrame, by: str, since: int | None) -> DataFrame:
    """Ids, key, usage, and whether each is the first copy."""
    by = "conversation" if by == CANONICAL else by
    if by not in DIMENSIONS:
        raise ValueError(f"cannot group usage by {by!r} (one of: {', '.join(DIMENSIONS)})")
    key = {"model": F.coalesce("model", F.lit("unknown")), "day": day(F.col("ts_ms")), "conversation": F.col("conversation_id"), "source": F.coalesce("source", F.lit("(no source)"))}[by]
    m = messages.where("role = 'assistant'")
    if since is not None:
        m = m.where(F.col("ts_ms") >= since)
    order = [c for c in ("file_ord", "file", "conversation_ord", "seq") if c in messages.columns]
    # only what is summed travels to the window
    m = m.select(*_IDS, *order, key.alias("key"), "usage")
    return m.withColumn("_first", F.row_number().over(Window.partitionBy(*_IDS).orderBy(*order)) == 1).select(*_IDS, "key", "usage", "_first")


def _rolled(marked: DataFrame) -> DataFrame:
    own = F.col("_first") & F.col("usage").isNotNull()
    total = lambda name: F.sum(F.when(own, F.coalesce(F.col(f"usage.{name}"), F.lit(0))).otherwise(0)).cast("long").alias(name)
    thinks = own & F.col("usage.reasoning_tokens").isNotNull()
    return marked.groupBy("key").agg(
        F.count_if(own).alias("messages"),
        F.count_if(F.col("_first") & F.col("usage").isNull()).alias("messages_without_usage"),
        *(total(c) for c in COUNTS[2:]),
        F.sum(F.when(thinks, F.col("usage.reasoning_tokens"))).alias("reasoning_tokens"),
        F.nullif(F.count_if(thinks), F.lit(0)).alias("reasoning_messages"),
        F.count_if(~F.col("_first")).alias("duplicates_skipped"),
    )


class UsageFold:
    """usage() over messages that come in batches, none of which is kept: only the ids of what was counted and the
    buckets' sums stay, as Parquet in path. A batch that is added again replaces itself, so add() fits foreachBatch.

    Batches are in input order: a copy counts if no batch before has its message.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "model", since: int | None = None):
        self.spark, self.path, self.by, self.since = spark, path.rstrip("/"), by, since

    def add(self, messages: DataFrame, batch: int) -> None:
        m = _marked(messages, self.by, self.since)
        before = self._read("ids", "conversation_id string, message_id string", batch)
        if before is not None:
            seen = before.select(*(F.col(c).alias(f"_{c}") for c in _IDS), F.lit(True).alias("_seen"))
            m = m.join(seen, F.col("conversation_id").eqNullSafe(F.col("_conversation_id")) & F.col("message_id").eqNullSafe(F.col("_message_id")), "left")
            m = m.withColumn("_first", F.col("_first") & F.col("_seen").isNull()).select(*_IDS, "key", "usage", "_first")
        m.where("_first").select(*_IDS).write.mode("overwrite").parquet(f"{self.path}/ids/batch={batch}")
        _rolled(m).write.mode("overwrite").parquet(f"{self.path}/sums/batch={batch}")

    def result(self) -> DataFrame:
        """The buckets so far, as usage() gives them."""
        sums = self._read("sums", _SUMS)
        sums = self.spark.createDataFrame([], _SUMS) if sums is None else sums
        return sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in (*COUNTS, "reasoning_tokens", "reasoning_messages", "duplicates_skipped"))).orderBy("key")

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame | None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        found = self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{name}")
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")


_SUMS = "key string, " + ", ".join(f"{c} long" for c in (*COUNTS, "reasoning_tokens", "reasoning_messages", "duplicates_skipped"))
_CAMEL = {c: re.sub(r"_(.)", lambda m: m[1].upper(), c) for c in (*COUNTS, "reasoning_tokens", "reasoning_messages", "duplicates_skipped")}


def usage_json(rolled: DataFrame) -> str:
    """Buckets as pretty JSON; a report, so its rows (one a key) come to the driver."""
    rows = [{"key": r["key"]} | {_CAMEL[c]: r[c] for c in _CAMEL if r[c] is not None} for r in rolled.collect()]
    return json.dumps(rows, indent=2, ensure_ascii=False)


def usage_table(rolled: DataFrame) -> str:
    """Buckets as aligned text; the reasoning column only where some bucket has it."""
    rows = rolled.collect()
    names = ["key", *COUNTS] + (["reasoning_tokens"] if any(r["reasoning_tokens"] is not None for r in rows) else [])
    heads = ["noUsage" if n == "messages_without_usage" else _CAMEL.get(n, n) for n in names]
    cells = [["" if r[n] is None else str(r[n]) for n in names] for r in rows]
    widths = [max(map(len, col)) for col in zip(heads, *cells, strict=True)]
    lines = [heads, ["-" * w for w in widths], *cells]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in lines)
