"""From files to canonical tables.

Files of ordinary size are read whole, one row a file, and imported where they lie: no shuffle. Line files too large
for one row are read by lines, sorted within their file and streamed through the same importers.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from colloquy.functions.values import clean
from colloquy.schema import IMPORTED
from colloquy.sources.detect import FORMATS, detect
from colloquy.sources.documents import DOCUMENT_IMPORTERS
from colloquy.sources.jsonl import LINE_IMPORTERS, ClaudeCode, NoConversation



def stem(file: str) -> str:
    """The file's name without its last extension."""
    base = file.replace("\\", "/").rsplit("/", 1)[-1]
    head, dot, tail = base.rpartition(".")
    return head if dot and tail else base


_ARROW = to_arrow_schema(IMPORTED)


def _tidy(value):
    """Strings that Arrow can hold."""
    if isinstance(value, str):
        return clean(value)
    if isinstance(value, dict):
        return {k: _tidy(v) for k, v in value.items()}
    return [_tidy(v) for v in value] if isinstance(value, list) else value


def _importer(form: str, file: str, now_ms: int, sidechains: bool):
    extra = {"include_sidechains": sidechains} if form == ClaudeCode.source else {}
    return LINE_IMPORTERS[form](now_ms, stem(file), **extra)


def _rows(file: str, file_ord: int, form: str | None, found, error: str | None = None, status: str = "ok", warnings: Iterable[str] = ()) -> list[dict]:
    base = {"file": file, "file_ord": file_ord, "format": form, "status": status, "error": error, "warnings": list(warnings)}
    if not found:
        return [base | {"status": "empty" if status == "ok" else status, "conversation_ord": None, "conversation": None, "messages": None}]
    return [base | {"warnings": base["warnings"] if i == 0 else [], "conversation_ord": i, "conversation": t, "messages": m} for i, (t, m) in enumerate(found)]


def import_text(content: str, file: str = "", file_ord: int = 0, form: str = "auto", now_ms: int = 0, include_sidechains: bool = False) -> list[dict]:
    """Rows of the imported table for one file: its conversations, or one row with status `no_conversation` (nothing
    in it to import), `empty` (an export of no conversations) or `failed` and the reason."""
    own = detect(content) if form == "auto" else form
    if own is None:
        return _rows(file, file_ord, None, None, f"{file}: format not recognized", "failed")
    warnings: list[str] = []
    try:
        if own in LINE_IMPORTERS:
            reader = _importer(own, file, now_ms, include_sidechains)
            reader.push(content.split("\n"))
            reader.finalize()
            warnings = reader.warnings()
            found = [reader.conversation()]
        else:
            found, warnings = DOCUMENT_IMPORTERS[own](content, now_ms, stem(file))
    except NoConversation as e:
        return _rows(file, file_ord, own, None, str(e), "no_conversation", warnings)
    except ValueError as e:
        return _rows(file, file_ord, own, None, str(e), "failed", warnings)
    return _rows(file, file_ord, own, found, None, "ok", warnings)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    try:
        return pa.RecordBatch.from_pylist(rows, _ARROW)
    except UnicodeEncodeError:  # a lone surrogate, which is rare
        return pa.RecordBatch.from_pylist([_tidy(r) for r in rows], _ARROW)


def _check(form: str) -> None:
    if form != "auto" and form not in FORMATS:
        raise ValueError(f"unknown input format {form!r} (one of: {', '.join(FORMATS)})")


def _now(now_ms: int | None) -> int:
    return int(time.time() * 1000) if now_ms is None else now_ms


_LOCAL = "^file:/+"
WHOLE_FILE = 256 << 20  # bytes; files beyond are read by lines
TOGETHER = 1000  # messages that leave a worker in one batch, about
SAMPLE = 20  # lines that tell the format of such a file


def listed(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(file, position, bytes) of the files that paths (files, folders and patterns) name: the first position counts.
    The files are listed once, by Spark; only folders and patterns are looked up one by one after that."""
    plain = lambda path: re.sub(_LOCAL, "/", path)
    files = spark.read.format("binaryFile").load(paths).select("path", "_metadata.file_path", "length")
    known = {plain(r["path"]): (re.sub(_LOCAL, "file:/", r["file_path"]), r["length"]) for r in files.collect()}
    found: dict[str, tuple[int, int]] = {}
    for i, p in enumerate(paths):
        own = [plain(p)] if plain(p) in known else _matches(spark, p)
        for file, n in (known[x] for x in own if x in known):
            found.setdefault(file, (i, n))
    return [(f, i, n) for f, (i, n) in found.items()]


def _matches(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, or a pattern fits."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(at) or ():
        out += [own.getPath().toString() for own in (fs.listStatus(status.getPath()) if status.isDirectory() else (status,))]
    return [re.sub(_LOCAL, "/", x) for x in out]


def _ordered(spark: SparkSession, files: DataFrame, found: list[tuple[str, int, int]]) -> DataFrame:
    """files (file, ...) with file_ord, each file's position in the list."""
    order = spark.createDataFrame([(f, i) for f, i, _ in found], "_path string, file_ord int")
    return files.join(F.broadcast(order), F.regexp_replace("file", _LOCAL, "file:/") == F.col("_path"), "left").withColumn("file_ord", F.coalesce("file_ord", F.lit(0)))


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_docs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_ord, content), one row a file. file_ord is the position in a list of paths, else 0."""
    paths = _as_list(paths)
    out = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return _ordered(spark, out, listed(spark, paths)).select("file", "file_ord", "content")


def sampled_format(spark: SparkSession, file: str) -> str | None:
    """The format of a large file, from its first SAMPLE lines."""
    return detect("\n".join(r["value"] for r in spark.read.text(file, lineSep="\n").limit(SAMPLE).collect()))


def import_docs(docs: DataFrame, form: str = "auto", now_ms: int | None = None, include_sidechains: bool = False) -> DataFrame:
    """The imported table of (file, file_ord, content) rows. Null content is an empty file: failed, not recognized."""
    _check(form)
    now = _now(now_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for file, order, content in zip(*b.columns, strict=True):  # one text at a time becomes a Python string
                found = import_text(content.as_py() or "", file.as_py() or "", order.as_py() or 0, form, now, include_sidechains)
                held += found
                size += sum(1 + len(r["messages"] or ()) for r in found)
                if size >= TOGETHER:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return docs.select("file", "file_ord", "content").mapInArrow(run, IMPORTED)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_ord, line_no, value) of line files of any size; lines end at \\n only, and line_no ascends."""
    paths = _as_list(paths)
    lines = spark.read.text(paths, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    # within a file blocks follow each other; within a block ids ascend in reading order (and never reach 2**33)
    return _ordered(spark, lines, listed(spark, paths)).select("file", "file_ord", (F.col("_block") * F.lit(1 << 20) + F.col("_id") % F.lit(1 << 33)).alias("line_no"), "value")


def import_lines(lines: DataFrame, form: str, now_ms: int | None = None, include_sidechains: bool = False) -> DataFrame:
    """The imported table of (file, file_ord, line_no, value) rows of one line format. Files are dealt out whole and
    streamed in line order: a task holds one conversation at a time, not its source."""
    if form not in LINE_IMPORTERS:
        raise ValueError(f"{form} files are one document each; read them with read_docs")
    now = _now(now_ms)

    def done(reader, file: str, order: int) -> pa.RecordBatch:
        try:
            reader.finalize()
            return _batch(_rows(file, order, form, [reader.conversation()], warnings=reader.warnings()))
        except NoConversation as e:
            return _batch(_rows(file, order, form, None, str(e), "no_conversation", reader.warnings()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = at = order = None
        for b in batches:
            for file, o, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != at:
                    if reader:
                        yield done(reader, at, order)
                    reader, at, order = _importer(form, file, now, include_sidechains), file, o
                reader.push([value or ""])
        if reader:
            yield done(reader, at, order)

    dealt = lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "file_ord", "value")
    return dealt.mapInArrow(run, IMPORTED)


def _refused(file: str, order: int, form: str | None) -> list[dict]:
    why = f"{file}: format not recognized" if form is None else f"{file}: a {form} export is one document, and too large to be read as one"
    return _rows(file, order, form, None, why, "failed")


def _by_size(spark: SparkSession, paths: list[str], form: str, now_ms: int | None, include_sidechains: bool, limit: int) -> DataFrame:
    """Files of up to limit bytes as documents; larger ones by lines, in the format that their first lines tell."""
    found = listed(spark, paths)
    large = [(f, i) for f, i, n in found if n > limit]
    if not large:
        return import_docs(read_docs(spark, paths), form, now_ms, include_sidechains)
    order = lambda df: _ordered(spark, df.drop("file_ord"), found)
    small = [f for f, _, n in found if n <= limit]
    parts = [import_docs(order(read_docs(spark, small)), form, now_ms, include_sidechains)] if small else []
    forms: dict[str | None, list[tuple[str, int]]] = {}
    for f, i in large:
        forms.setdefault(sampled_format(spark, f) if form == "auto" else form, []).append((f, i))
    refused = []
    for own, files in forms.items():
        if own in LINE_IMPORTERS:
            parts.append(import_lines(order(read_lines(spark, [f for f, _ in files])), own, now_ms, include_sidechains))
        else:
            refused += [r for f, i in files for r in _refused(f, i, own)]
    if refused:
        parts.append(spark.createDataFrame(refused, IMPORTED))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_transcripts(spark: SparkSession, paths: str | list[str], form: str = "auto", now_ms: int | None = None, include_sidechains: bool = False, by_lines: bool = False, mode: str = "PERMISSIVE", limit: int = WHOLE_FILE) -> DataFrame:
    """The imported table of files. Those beyond limit bytes are read by lines; by_lines, with a line format, has all
    read so. mode FAILFAST raises at the first file that cannot be read."""
    _check(form)
    paths = _as_list(paths)
    imported = import_lines(read_lines(spark, paths), form, now_ms, include_sidechains) if by_lines else _by_size(spark, paths, form, now_ms, include_sidechains, limit)
    if mode == "FAILFAST":
        bad = F.raise_error(F.coalesce("error", F.lit("unreadable file")))
        return imported.withColumn("status", F.when(F.col("status") == "failed", bad).otherwise(F.col("status")))
    return imported


def conversations(imported: DataFrame) -> DataFrame:
    """One row a conversation."""
    return imported.where("conversation is not null").select("file", "file_ord", "conversation_ord", "conversation.*")


def messages(imported: DataFrame) -> DataFrame:
    """One row a message, with its conversation's source and title columns beside it."""
    t = imported.where("conversation is not null").select("file", "file_ord", "conversation_ord", "conversation.source", F.posexplode("messages").alias("seq", "m"))
    return t.select("file", "file_ord", "conversation_ord", "seq", "source", "m.*")


def warnings(imported: DataFrame) -> DataFrame:
    """What was skipped or dropped, and which files hold no conversation or failed."""
    said = imported.select("file", "format", F.lit("disclosure").alias("kind"), F.explode("warnings").alias("message"))
    return said.unionByName(imported.where("status <> 'ok'").select("file", "format", F.col("status").alias("kind"), F.col("error").alias("message")))


def detect_formats(docs: DataFrame) -> DataFrame:
    """(file, format) of (file, content) rows; null where nothing fits."""

    def run(batches):
        for b in batches:
            files, contents = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([detect(c or "") for c in contents], pa.string())], ["file", "format"])

    return docs.select("file", "content").mapInArrow(run, "file string, format string")
