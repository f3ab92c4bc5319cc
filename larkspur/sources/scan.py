"""Source files from directories and archives, as one row per file.

Archives are read in memory and never extracted to disk.  A member that
cannot be read gives a row with a null content and an ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import catalogue as C
from larkspur.operators.order import with_sequence
from larkspur.sources import archives
from larkspur.sources.archives import Stored

SCHEMA = "file_id string, archive_path string, file_path string, content string, error string"
_KINDS = re.compile(r"\.(py|zip|tar\.gz)$", re.I)
#: Stored bytes of an archive that one task unpacks, and of rows that go to Python and back at once.
PART_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
_STORED = "name string, data binary, error string, method int, flags int, crc long, time int, key_bytes int"
_FOUND = f"archive_path string, place int, part long, {_STORED}"


def _text(data: bytes) -> str | None:
    """UTF-8, with or without a byte order mark; null for anything else."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None


def stored(path: str, data: bytes) -> Iterator[tuple[str | None, Stored]]:
    """The sources in one file as they are stored, each with the path of its archive."""
    low = path.lower()
    if low.endswith(".py"):
        yield None, Stored(path, data)
        return
    try:
        for member in (archives.zip_members if low.endswith(".zip") else archives.tar_members)(data):
            member.name = member.name or path
            yield path, member
    except Exception as error:  # an archive that cannot be read is a row
        yield path, Stored(path, None, f"{type(error).__name__}: {error}")


def read_member(member: Stored) -> tuple[str | None, str | None]:
    """The text of a source, or null and what is wrong with it."""
    if member.data is None:
        return None, member.error
    try:
        text = _text(archives.unpacked(member))
    except Exception as error:  # one member that cannot be read
        return None, f"{type(error).__name__}: {error}"
    return text, "not UTF-8" if text is None else None


def members(path: str, data: bytes) -> Iterator[tuple[str | None, str, str | None, str | None]]:
    """archive_path, file_path, content and error of the sources in one file."""
    for archive, member in stored(path, data):
        yield archive, member.name, *read_member(member)


def expand(files: DataFrame, exclude: list[str] = (), tasks: int | None = None) -> DataFrame:
    """Rows of ``files`` (path, length, content as bytes) to one row per source.

    Files and archives with an excluded base name are left out, members of
    archives are not.  Archives over the size limit are a row with an error;
    they are not read.  The sources of an archive are found by the task that
    has it, dealt to ``tasks`` (four for each core where not given) by their
    stored sizes, and unpacked there, each up to ``archives.MEMBER_BYTES``.
    ``place`` is a source's place in its archive.
    """
    small = (~F.lower("path").endswith(".py")) & (F.col("length") > C.MAX_ARCHIVE_BYTES)
    base = F.regexp_extract("path", r"([^/\\]*)$", 1)
    kept = files.where(~base.isin(list(exclude))) if exclude else files

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size, total = [], 0, 0
                for place, (archive, member) in enumerate(stored(path, data.as_py())):
                    held.append((archive, place, total // PART_BYTES, *astuple(member)))
                    size, total = size + len(member.data or b""), total + len(member.data or b"")
                    if size > BATCH_BYTES:
                        yield _rows(held, _FOUND_ARROW)
                        held, size = [], 0
                yield _rows(held, _FOUND_ARROW)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):  # one member at a time
                archive, place, _, *fields = (c[i].as_py() for c in batch.columns)
                member = Stored(*fields)
                content, error = read_member(member)
                held.append((archive, member.name, content, error, place))
                size += len(content or "")
                if size > BATCH_BYTES:
                    yield _rows(held, _READ_ARROW)
                    held, size = [], 0
            yield _rows(held, _READ_ARROW)

    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    found = kept.where(~small).select("path", "content").mapInArrow(find, _FOUND)
    dealt = found.repartition(tasks, F.coalesce("archive_path", "name"), "part")
    read = dealt.mapInArrow(unpack, SCHEMA.replace("file_id string, ", "") + ", place int")
    large = kept.where(small).select(F.col("path").alias("archive_path"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("content"), F.lit("archive too large").alias("error"), F.lit(0).alias("place"))
    return read.unionByName(large).select(F.sha2(F.concat_ws("\0", "archive_path", "file_path"), 256).alias("file_id"), "*")


_STORED_ARROW = [("name", pa.string()), ("data", pa.binary()), ("error", pa.string()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("time", pa.int32()), ("key_bytes", pa.int32())]
_FOUND_ARROW = pa.schema([("archive_path", pa.string()), ("place", pa.int32()), ("part", pa.int64()), *_STORED_ARROW])
_READ_ARROW = pa.schema([("archive_path", pa.string()), ("file_path", pa.string()), ("content", pa.string()), ("error", pa.string()), ("place", pa.int32())])


def _rows(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*held)) if held else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def in_walk_order(rows: DataFrame, name: str = "seq") -> DataFrame:
    """``rows`` of a scan, or results of them, with their number in the order of the walk.

    Files stand in the order of their paths, directory by directory, and an
    archive's sources in that of its index.  Sort by it where results leave.
    """
    # a directory's entries are compared by name, so the separator comes before any other character
    path = F.translate(F.coalesce("archive_path", "file_path"), "/", "\x01")
    return with_sequence(rows, [path, F.col("place"), F.col("file_path")], name)


def scan(spark: SparkSession, path: str, exclude: list[str] = (), empty_ok: bool = False) -> DataFrame:
    """Sources below ``path``: .py files and members of .zip and .tar.gz archives.  Raises where there are none, unless ``empty_ok``.

    Files of no bytes have no row: the reader of binary files leaves them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("path").rlike(_KINDS.pattern.replace(r"\.(", r"(?i)\.(")))
    files = files.where(~F.regexp_extract("path", r"([^/\\]*)$", 1).isin(list(exclude))) if exclude else files
    if not empty_ok and files.select("path").isEmpty():
        raise ValueError(f"No Python files found: {path}")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return expand(files, tasks=max(4 * spark.sparkContext.defaultParallelism, int(total // PART_BYTES)))


def exclusions(text: str) -> list[str]:
    """Base names of an exclude list: one a line, # starts a comment."""
    return [name for line in text.splitlines() if (name := line.split("#", 1)[0].strip())]
