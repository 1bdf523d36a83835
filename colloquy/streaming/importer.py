"""Line transcripts as a stream: importers kept as keyed state, messages emitted as upserts.

A later line can change a message that was announced (a split record, a token count, a model learnt late), so what
comes out is not append-only: each row is the message's present form with a version, and upserts() keeps the last.
A conversation's own columns come the same way, as row HEAD, with its warnings; heads() keeps the last.
An end row (value null) finalizes its file, as a time-out could not know that no line will come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.values import clean
from colloquy.schema import CONVERSATION_DDL, MESSAGE_DDL
from colloquy.sources.jsonl import LINE_IMPORTERS, NoConversation
from colloquy.sources.scan import stem

HEAD = -1  # in the place of a message's number

#: A row a changed message: its JSON form, so that the state's schema need not follow the canonical one.
UPSERT = T.StructType([T.StructField("file", T.StringType()), T.StructField("conversation_id", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("version", T.LongType()), T.StructField("message", T.StringType())])


class Paged:
    """A list of messages that are read when they are asked for."""

    def __init__(self, n: int, load):
        self.n, self.load, self.held = n, load, {}

    def __len__(self) -> int:
        return self.n

    def append(self, m: dict) -> None:
        self.held[self.n] = m
        self.n += 1

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(self.n))]
        i += self.n if i < 0 else 0
        if not 0 <= i < self.n:
            raise IndexError(i)
        if i not in self.held:
            self.held[i] = json.loads(self.load(i)[0])
        return self.held[i]


class Session:
    """One file's importer between batches. save() is text without messages; load(i) gives what push() said is to be
    kept of message i: its JSON and a mark of what was emitted. Only messages that lines touch are read and written."""

    def __init__(self, form: str, file: str, now_ms: int, saved: str | None = None, load=None):
        held = json.loads(saved) if saved else {"state": None, "n": 0, "version": 0, "head": "", "open": [-1, ""]}
        self.file, self.load = file, load
        self.reader = LINE_IMPORTERS[form](now_ms, stem(file), state=held["state"])
        self.kept = held["n"]
        self.reader.s["messages"] = Paged(self.kept, load)
        self.version, self.head, self.open = held["version"], held["head"], held["open"]

    def save(self) -> str:
        state = {k: v for k, v in self.reader.s.items() if k != "messages"}
        return json.dumps({"state": state, "n": self.kept, "version": self.version, "head": self.head, "open": self.open})

    def push(self, lines: list[str | None]) -> tuple[list[tuple], dict[int, tuple[str, str]]]:
        """Rows of UPSERT for the messages that these lines, in order, add or change, and what to keep by number. None
        among the lines is the end."""
        r = self.reader
        r.push([x for x in lines if x is not None])
        if None in lines:
            r.finalize()
        try:
            r.ready()
        except NoConversation:
            return [], {}
        n, own = r.count(), r.conversation_id()
        head = r.head([r.present(0), r.present(n - 1)])
        self.version += 1
        out: list[tuple] = []

        def emit(i: int, value, before: str) -> str:
            text = clean(json.dumps(value, ensure_ascii=False, default=str))
            mark = str(hash_text(own + text))
            if mark != before:
                out.append((self.file, own, i, self.version, text))
            return mark

        self.head = emit(HEAD, {"conversation": head, "warnings": r.warnings()}, self.head)
        keep, unsent = {}, self.open
        for i in sorted(r.touched | {n - 1}):
            before = unsent[1] if i == unsent[0] else self.load(i)[1] if i < self.kept else ""
            mark = emit(i, r.present(i), before)
            if i < len(r.s["messages"]):
                keep[i] = json.dumps(r.s["messages"][i]), mark
                self.open = [-1, ""] if i == self.open[0] else self.open
            else:
                self.open = [i, mark]
        self.kept = len(r.s["messages"])
        return out, keep


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big")


class Importer(StatefulProcessor):
    """transformWithStateInPandas over rows (file, line_no, value) keyed by file."""

    def __init__(self, form: str, now_ms: int = 0):
        self.form, self.now_ms = form, now_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("importer", T.StructType([T.StructField("json", T.StringType())]))
        self.messages = handle.getMapState("messages", "i int", "json string, mark string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.saved.get()[0] if self.saved.exists() else None
        session = Session(self.form, key[0], self.now_ms, held, lambda i: tuple(self.messages.getValue((i,))))
        batch = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        out, keep = session.push([None if v is None or v is pd.NA or v != v else v for v in batch["value"]])
        for i, kept in keep.items():
            self.messages.updateValue((i,), kept)
        self.saved.update((session.save(),))
        yield pd.DataFrame(out, columns=UPSERT.names)

    def close(self) -> None:
        pass


def stream_messages(lines: DataFrame, form: str, now_ms: int = 0) -> DataFrame:
    """UPSERT rows of a streaming (file, line_no, value): complete lines, null for a file's end. Needs the RocksDB
    state store. Lines of one file must not arrive in a later batch than ones after them."""
    if form not in LINE_IMPORTERS:
        raise ValueError(f"{form} is not a line format")
    return lines.groupBy("file").transformWithStateInPandas(Importer(form, now_ms), outputStructType=UPSERT, outputMode="Update", timeMode="None")


def _last(changes: DataFrame) -> DataFrame:
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy("file", "seq").orderBy(F.desc("version")))).where("_n = 1")


def upserts(changes: DataFrame) -> DataFrame:
    """The present messages of accumulated UPSERT rows, in the columns of scan.messages: what usage() reads. The
    stream's files have no order among them: their names stand for it."""
    now = _last(changes.where(F.col("seq") > HEAD)).select("file", "seq", F.from_json("message", MESSAGE_DDL).alias("m"))
    source = heads(changes).select(F.col("file").alias("_file"), "source")
    now = now.join(source, F.col("file") == F.col("_file"), "left")
    return now.select("file", F.lit(0).alias("file_ord"), F.lit(0).alias("conversation_ord"), "seq", "source", "m.*")


def heads(changes: DataFrame) -> DataFrame:
    """The present conversations of accumulated UPSERT rows, a row a file: file, warnings and a conversation's columns."""
    head = F.from_json("message", f"struct<conversation:{CONVERSATION_DDL},warnings:array<string>>").alias("h")
    return _last(changes.where(F.col("seq") == HEAD)).select("file", head).select("file", "h.warnings", "h.conversation.*")


def import_stream(lines: DataFrame, form: str, folder: str, now_ms: int = 0) -> DataFrame:
    """All that a streaming (file, line_no, value) has now, imported: the UPSERT rows in folder. A batch that runs
    again after a failure overwrites what it wrote."""
    spark = lines.sparkSession
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        write = stream_messages(lines, form, now_ms).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
        write.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(UPSERT).parquet(f"{folder}/changes")
