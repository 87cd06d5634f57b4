"""A dataset of several files, written as a whole or not at all.

Files are written by Spark to a folder of their own beside the released ones.
Only when all of them are there, no issue is an error and none is larger than
its budget is the folder renamed to its place, and a pointer, one small file,
replaced; until then, and after any failure, readers find the release before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.sinks.export import as_table, content_version

_POINTER = "CURRENT"
#: What the table of the texts' names adds to their folder's name.
_NAMES = "-names"
_READ_CHARS = 1 << 22


class Refused(ValueError):
    """The dataset has errors or is too large; nothing has been released."""


class Release:
    """with Release(spark, path, issues) as out: out.lines(...); out.table(...); out.texts(...)

    issues: rows with level; any "error" refuses the release. The version is made of all rows' contents, so the same
    content gives the same version wherever and however often it is built.
    """

    def __init__(self, spark: SparkSession, path: str, issues: DataFrame | None = None):
        self.spark, self.path, self.issues = spark, path.rstrip("/"), issues
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        self.parts: dict[str, dict] = {}
        self.version: str | None = None

    def __enter__(self) -> Release:
        if self.issues is not None:
            errors = self.issues.where("level = 'error'").count()
            if errors:
                raise Refused(f"{errors} error(s); nothing is released")
        return self

    def __exit__(self, kind, error, trace) -> None:
        fs, place = _files(self.spark, self.staging)
        try:
            if kind is None:
                self._commit()
        finally:
            fs.delete(place, True)

    def lines(self, name: str, json_lines: DataFrame, order: list[str], budget: int | None = None) -> None:
        """json_lines: json and the columns of order. One record a line; the files in order are the records in order."""
        rows = json_lines.orderBy(*order)
        rows.select("json").write.text(f"{self.staging}/{name}")
        self._add(name, json_lines.select(F.col("json").alias("line")), budget)

    def table(self, name: str, rows: DataFrame, columns: list[str], order: list[str], budget: int | None = None) -> None:
        """CSV with a header, lists joined by "|", in order."""
        cells = as_table(rows.orderBy(*order), columns)
        cells.write.csv(f"{self.staging}/{name}", header=True, emptyValue="")
        self._add(name, as_table(rows, columns).select(F.to_json(F.array(*columns)).alias("line")), budget)

    def texts(self, name: str, texts: DataFrame, budget: int | None = None) -> None:
        """texts: file, text. A text a file, of that name; read_texts() finds them by a table beside them. Names may not repeat.

        Tasks write the files, so nothing on the driver grows with their number. A task that is run again writes the same.
        """
        twice = texts.groupBy("file").count().where("count > 1").limit(1).collect()
        if twice:
            raise Refused(f"{name}: two texts for {twice[0][0]}")
        folder = _uri(self.spark, f"{self.staging}/{name}")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = FileSystem.from_uri(folder)
            files.create_dir(root, recursive=True)
            for batch in batches:
                for file, text in zip(batch["file"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    with files.open_output_stream(f"{root}/{_file_name(file)}", compression=None) as out:
                        out.write(text.encode())
                sizes = pc.binary_length(batch["text"].cast(pa.binary())).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch["file"], sizes], names=["file", "bytes"])

        whole = texts.select("file", F.coalesce("text", F.lit("")).alias("text"))
        whole.mapInArrow(write, "file string, bytes long").write.parquet(f"{self.staging}/{name}{_NAMES}")
        size = self.spark.read.schema("file string, bytes long").parquet(f"{self.staging}/{name}{_NAMES}").agg(F.sum("bytes")).first()[0]
        self._add(name, texts.select(F.to_json(F.struct("file", "text")).alias("line")), budget, size or 0)

    def _add(self, name: str, lines: DataFrame, budget: int | None, size: int | None = None) -> None:
        if size is None:
            fs, place = _files(self.spark, f"{self.staging}/{name}")
            size = fs.getContentSummary(place).getLength()
        if budget is not None and size > budget:
            raise Refused(f"{name} has {size} bytes, more than {budget}")
        made = content_version(lines).first()
        self.parts[name] = {"bytes": size, "rows": made["lines"], "version": made["version"] or "0"}

    def _commit(self) -> None:
        made = "|".join(f"{n}:{p['rows']}:{p['version']}" for n, p in sorted(self.parts.items()))
        self.version = self.spark.range(1).select(F.substring(F.sha2(F.lit(made), 256), 1, 12)).first()[0]
        _put(self.spark, f"{self.staging}/meta.json", json.dumps({"version": self.version, "parts": self.parts}))
        fs, staged = _files(self.spark, self.staging)
        _, target = _files(self.spark, f"{self.path}/{self.version}")
        if not fs.exists(target) and not fs.rename(staged, target):
            raise Refused(f"{target} could not be put in place")
        _put(self.spark, f"{self.path}/{_POINTER}", self.version)


def released(spark: SparkSession, path: str) -> str | None:
    """The folder of the current release; None before the first."""
    fs, place = _files(spark, f"{path.rstrip('/')}/{_POINTER}")
    if not fs.exists(place):
        return None
    return f"{path.rstrip('/')}/{spark.read.text(str(place.toString())).first()[0]}"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of what Release.texts() wrote: tasks share the names and open their files."""
    place = _uri(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(place)
        for batch in batches:
            names = batch["file"].to_pylist()
            # So few texts at once as have some megabytes.
            at, held, texts = 0, 0, []
            for i, name in enumerate(names):
                with files.open_input_stream(f"{root}/{_file_name(name)}", compression=None) as file:
                    texts.append(file.read().decode())
                held += len(texts[-1])
                if held > _READ_CHARS or i == len(names) - 1:
                    yield pa.RecordBatch.from_pydict({"file": pa.array(names[at : i + 1], pa.string()), "text": pa.array(texts, pa.string())})
                    at, held, texts = i + 1, 0, []

    names = spark.read.schema("file string, bytes long").parquet(f"{folder.rstrip('/')}{_NAMES}").select("file")
    return names.repartition("file").mapInArrow(read, "file string, text string")


def section_file(section_id: Column, title: Column, plain: Column) -> Column:
    """The name of a section's file: its id and at most 60 characters of its title, of which plain is the text without marks."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(section_id, F.lit("_"), F.substring(slug, 1, 60), F.lit(".txt"))


def section_text(section_id: Column, number: Column, title: Column, book: Column, chapter: Column, chapter_title: Column, first_page: Column, last_page: Column, text: Column) -> Column:
    """A section as a file's text: three lines that say what it is, an empty line, the text and an end of line."""
    s = lambda c: c.cast("string")
    head = [F.concat(F.lit("# "), section_id, F.lit(" — "), s(number), F.lit(". "), title), F.concat(F.lit("# Livre "), s(book), F.lit(", chapitre "), s(chapter), F.lit(": "), chapter_title), F.concat(F.lit("# Printed pages "), s(first_page), F.lit("–"), s(last_page))]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n\n"), text, F.lit("\n"))


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _uri(spark: SparkSession, path: str) -> str:
    """The path as tasks open it, with its file system."""
    fs, place = _files(spark, path)
    whole = fs.makeQualified(place).toUri()
    return whole.toString() if whole.getAuthority() else f"{whole.getScheme()}://{quote(whole.getPath())}"


def _file_name(file: str) -> str:
    """A text's name as that of its file: what would lead to another folder is escaped, and so are the names of folders themselves."""
    safe = file.replace("%", "%25").replace("/", "%2F")
    return safe.replace(".", "%2E") if safe in (".", "..") else safe


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file written at once over what is there."""
    fs, place = _files(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
