"""Tables in delimited files as a source and a sink of Spark, through the Python data source interface.

    spark.dataSource.register(TableFiles)
    spark.read.format("table_files").load(folder)                            # one record a row: sheet, header, values, types
    spark.read.format("table_files").option("typed", True).load(folder)      # the files' own columns, with types
    spark.read.format("table_files").option("sheets", True).load(folder)     # one record a file: what is known of it
    rows.write.format("question_files").mode("append").save(folder)

Each file is a partition, read as a stream by the task that has it: no file goes to the driver, whose inference reads the first
rows of one file only. Encoding and delimiter are found by file, the header row, too. Paths are folders, files or patterns of
names in any store that pyarrow's file systems reach.
"""

from __future__ import annotations

import codecs
import csv
import fnmatch
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import islice

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from granary.sources.files import ENCODINGS, QA_SCHEMA, delimiter_of

# Rows that types are voted on, the name of a column without one, truth words, the share of texts that decides.
SAMPLE_ROWS = 100
UNNAMED = "列{}"
TRUE_WORDS, FALSE_WORDS = ("是", "true", "True", "TRUE", "1"), ("否", "false", "False", "FALSE", "0")
TEXT_SHARE = 0.3
DATES = (r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{8}$")

SPARK_TYPES = {"bool": T.BooleanType(), "datetime": T.TimestampType(), "int": T.LongType(), "float": T.DoubleType(), "text": T.StringType()}
ROWS = "path string, sheet_name string, row_index long, header array<string>, values array<string>, column_types map<string, string>"
SHEETS = "path string, sheet_name string, encoding string, delimiter string, header array<string>, header_row_number int, row_count long, column_types map<string, string>"
_BOM = "﻿"
_CHUNK = 1 << 20


def value_kind(value: str) -> str:
    """bool, datetime, int, float or text."""
    if value in TRUE_WORDS or value in FALSE_WORDS:
        return "bool"
    if any(re.match(p, value) for p in DATES):
        return "datetime"
    for kind, parse in (("int", int), ("float", float)):
        try:
            parse(value)
        except ValueError:
            continue
        return kind
    return "text"


def voted_kind(values: Iterable[str]) -> str:
    """The kind of a column: text if more than three in ten values that aren't blank are, else the first there is of bool, datetime, int, float."""
    kinds = [value_kind(v.strip()) for v in values if v and v.strip()]
    if not kinds or kinds.count("text") > TEXT_SHARE * len(kinds):
        return "text"
    return next(k for k in (*SPARK_TYPES,) if k in kinds)


def typed(value: str, kind: str):
    """A cell as its column's type; None where it is blank or isn't of that type."""
    try:
        if not value:
            return None
        if kind == "bool":
            return True if value in TRUE_WORDS else False if value in FALSE_WORDS else None
        if kind == "datetime":
            return _moment(value)
        if kind == "int":
            found = int(value)
            return found if -(1 << 63) <= found < 1 << 63 else None
        return float(value) if kind == "float" else value
    except ValueError:
        return None


def _moment(value: str) -> datetime:
    if re.fullmatch(r"\d{8}", value):
        return datetime(int(value[:4]), int(value[4:6]), int(value[6:]))
    date, _, time = re.sub(r"[Tt]", " ", value.replace("/", "-")).partition(" ")
    year, month, day = map(int, date.split("-"))
    hour, minute, second = (*map(int, time.strip().split(":")), 0, 0, 0)[:3] if time.strip() else (0, 0, 0)
    return datetime(year, month, day, hour, minute, second)


@dataclass(frozen=True)
class Reading:
    """How files are read: rows in which the header is sought (1: the first that isn't blank), and limits of rows and columns of a file (none: all)."""

    header_rows: int = 1
    most_rows: int | None = None
    most_columns: int | None = None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files below a folder, of a pattern, or one file, sorted; hidden ones don't count."""
    store, at = _store(path)
    pattern = None
    if any(c in at.rsplit("/", 1)[-1] for c in "*?["):
        at, pattern = at.rsplit("/", 1)
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    names = [f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and "/_" not in f.path[len(at) :]]
    return sorted(n for n in names if pattern is None or fnmatch.fnmatch(n.rsplit("/", 1)[-1], pattern))


def _encoding(store: fs.FileSystem, name: str) -> str:
    """The first encoding that fits the whole file, which is read in chunks."""
    for encoding in ENCODINGS[:-1]:
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            with store.open_input_stream(name) as data:
                while chunk := data.read(_CHUNK):
                    decoder.decode(chunk)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            continue
        return encoding
    return ENCODINGS[-1]


class _Sheet:
    """A delimited file: its form, header and rows, read as a stream."""

    def __init__(self, store: fs.FileSystem, name: str, how: Reading):
        self.store, self.name, self.how = store, name, how
        self.encoding = _encoding(store, name)
        with self._text() as lines:
            self.delimiter = delimiter_of([line.lstrip(_BOM) for line in islice(lines, 5)])
        self.sheet = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        raw = list(islice(self._cells(), how.header_rows))
        self.number, first = self._found(raw)
        bare = first if any(first) and how.header_rows == 1 else [c or UNNAMED.format(i + 1) for i, c in enumerate(first)]
        self.header = bare
        sample = list(islice((values for _, values in self.rows()), SAMPLE_ROWS))
        self.kinds = [voted_kind(row[i] for row in sample) for i in range(len(self.header))]

    def _text(self) -> io.TextIOWrapper:
        return io.TextIOWrapper(self.store.open_input_stream(self.name), encoding=self.encoding, newline="")

    def _cells(self) -> Iterator[tuple[int, list[str]]]:
        """Row numbers from 1 and trimmed cells of the rows that aren't blank."""
        with self._text() as lines:
            for number, cells in enumerate(csv.reader(lines, delimiter=self.delimiter), 1):
                if self.how.most_rows is not None and number > self.how.most_rows:
                    return
                if number == 1 and cells:
                    cells[0] = cells[0].lstrip(_BOM)
                kept = [c.strip() for c in cells[: self.how.most_columns]]
                if any(kept):
                    yield number, kept

    def _found(self, rows: list[tuple[int, list[str]]]) -> tuple[int, list[str]]:
        """The first of the rows with two cells that aren't blank, else the fullest."""
        if not rows:
            return 0, []
        filled = [sum(map(bool, cells)) for _, cells in rows]
        return rows[next((i for i, n in enumerate(filled) if n >= 2), filled.index(max(filled)))] if self.how.header_rows > 1 else rows[0]

    def rows(self) -> Iterator[tuple[int, list[str]]]:
        """Numbers from 1 and values of the rows below the header, cut or filled to its length."""
        n = len(self.header)
        below = (cells[:n] + [""] * (n - len(cells)) for number, cells in self._cells() if number > self.number)
        return enumerate((values for values in below if any(values)), 1)

    def types(self) -> dict[str, str]:
        return dict(zip(self.header, self.kinds, strict=True))


def _names(header: list[str]) -> list[str]:
    """Column names: those of a header, unnamed ones by number, repeated ones with a number behind."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = bare = name or UNNAMED.format(i + 1)
        n = 2
        while name.lower() in (o.lower() for o in out):
            name, n = f"{bare}_{n}", n + 1
        out.append(name)
    return out


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class TableFiles(DataSource):
    """Format "table_files": rows, typed tables or sheets of delimited files. Options: path, typed, sheets, headerRows, maxRows, maxColumns."""

    @classmethod
    def name(cls) -> str:
        return "table_files"

    def _reading(self) -> Reading:
        number = lambda key: int(self.options[key]) if self.options.get(key) else None
        return Reading(number("headerRows") or 1, number("maxRows"), number("maxColumns"))

    def schema(self) -> T.StructType | str:
        if _flag(self.options, "sheets"):
            return SHEETS
        if not _flag(self.options, "typed"):
            return ROWS
        names = listed(self.options["path"])
        if not names:
            raise ValueError(f"no files in {self.options['path']}")
        sheet = _Sheet(_store(self.options["path"])[0], names[0], self._reading())
        return T.StructType([T.StructField(n, SPARK_TYPES[k]) for n, k in zip(_names(sheet.header), sheet.kinds, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        mode = "sheets" if _flag(self.options, "sheets") else "typed" if _flag(self.options, "typed") else "rows"
        return _Reader(self.options["path"], mode, self._reading(), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, mode: str, how: Reading, schema: T.StructType):
        self.path, self.mode, self.how, self.schema = path, mode, how, schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in listed(self.path)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        sheet = _Sheet(_store(self.path)[0], partition.value, self.how)
        if self.mode == "sheets":
            if sheet.header:
                yield (sheet.name, sheet.sheet, sheet.encoding, sheet.delimiter, sheet.header, sheet.number, sum(1 for _ in sheet.rows()), sheet.types())
        elif self.mode == "rows":
            types = sheet.types()
            for number, values in sheet.rows():
                yield (sheet.name, sheet.sheet, number, sheet.header, values, types)
        else:
            yield from self._typed(sheet)

    def _typed(self, sheet: _Sheet) -> Iterator[tuple]:
        """Cells by name as the schema has them; a column that a file lacks is null there."""
        kinds = {type(v): k for k, v in SPARK_TYPES.items()}
        place = {n: i for i, n in enumerate(_names(sheet.header))}
        columns = [(place.get(f.name), kinds[type(f.dataType)]) for f in self.schema]
        for _, values in sheet.rows():
            yield tuple(None if i is None else typed(values[i], kind) for i, kind in columns)


# What joins lists in a question file.
SIMILAR_MARK, TAG_MARK = "||", ","


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class QuestionFiles(DataSource):
    """Format "question_files": question-and-answer rows (question, answer, similar_questions, category, tags, enabled) as delimited
    files with a header and one byte-order mark each. Other columns are an error, missing ones are blank; lists are joined."""

    @classmethod
    def name(cls) -> str:
        return "question_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        unknown = set(schema.names) - set(QA_SCHEMA.names)
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return _QuestionWriter(self.options["path"], overwrite)


class _QuestionWriter(DataSourceWriter):
    """Tasks write into a folder of this job alone; its files move to their place when all have ended well, else the folder goes."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        store, at = _store(self.path)
        return store, at, f"{at}/_writing-{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, _, folder = self._folder()
        first = next(iterator, None)
        if first is None:
            return _Written(None, 0)
        context = TaskContext.get()
        store.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.csv"
        n = 0
        with io.TextIOWrapper(store.open_output_stream(f"{folder}/{name}"), encoding="utf-8-sig", newline="") as out:
            writer = csv.writer(out, lineterminator="\n")
            writer.writerow(QA_SCHEMA.names)
            for row in (r for some in ((first,), iterator) for r in some):
                writer.writerow(_cells_of(row.asDict()))
                n += 1
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at, folder = self._folder()
        store.create_dir(at, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.file is not None:
                store.move(f"{folder}/{m.file}", f"{at}/{m.file[:10]}-{self.job}.csv")
        for name in old:
            store.delete_file(name)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _, folder = self._folder()
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def _cells_of(row: dict) -> list[str]:
    """The cells of a question-and-answer row, trimmed; blank parts of lists go."""
    text = lambda v: str(v or "").strip()
    joined = lambda v, mark: mark.join(x for x in map(text, v or ()) if x)
    enabled = row.get("enabled")
    return [text(row.get("question")), text(row.get("answer")), joined(row.get("similar_questions"), SIMILAR_MARK), text(row.get("category")), joined(row.get("tags"), TAG_MARK), "false" if enabled is False else "true"]


def registered(spark) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(TableFiles)
    spark.dataSource.register(QuestionFiles)
