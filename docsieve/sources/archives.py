"""Zip archives of CSV files: written from groups of rows, detected, guarded and read."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MEMBER, MOST_ARCHIVE = 10 << 20, 100 << 20
AT_ONCE = 4 << 20  # bytes of archives or texts that are handed on together
# Our own names of the files of an export.
EXPORT = ("profile.csv", "positions.csv", "education.csv", "skills.csv", "certificates.csv", "languages.csv")
MEMBERS = "archive string, member string, size long, verdict string, text string"


def packed(files: DataFrame) -> DataFrame:
    """The members (``archive``, ``member``, ``text``) zipped: a row (``path``, ``content``) for each archive.

    As a table, many small archives need no file each, which the driver would have to list. An archive's members
    meet in one task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents, name, buffer, out = [], [], None, None, None

        def close() -> None:
            out.close()
            names.append(name)
            contents.append(buffer.getvalue())

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != name:
                    if out is not None:
                        close()
                        held += len(contents[-1])
                        if held >= AT_ONCE:
                            yield rows()
                            names, contents, held = [], [], 0
                    name, buffer = row["archive"], io.BytesIO()
                    out = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                out.writestr(zipfile.ZipInfo(row["member"]), row["text"] or "")
        if out is not None:
            close()
        yield rows()

    dealt = files.select("archive", "member", "text").repartition("archive").sortWithinPartitions("archive", "member")
    return dealt.mapInArrow(pack, "path string, content binary")


def write_archives(files: DataFrame, path: str) -> DataFrame:
    """Writes each archive as a file of its own name to ``path``, so that a second attempt writes the same, and returns their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        place.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with place.open_output_stream(f"{root}/{name}", compression=None) as sink:
                    sink.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["archive"])

    return packed(files).mapInArrow(write, "archive string")


def unpacked(archives: DataFrame, allowed: tuple[str, ...] = EXPORT, most_member: int = MOST_MEMBER, most_archive: int = MOST_ARCHIVE) -> DataFrame:
    """A row for each member of the archives (``path``, ``content``): ``MEMBERS``.

    ``text`` is null unless the ``verdict`` is ok: the base name is allowed, the member and its archive, by their
    sizes when unpacked, are under the limits. What is no archive has one row with the verdict so; a member
    that is encrypted or can't be unpacked has that as its verdict.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for row in members(name.rsplit("/", 1)[-1], content.as_py()):
                    rows.append(row)
                    held += 100 + len(row[4] or "")
                    if held >= AT_ONCE:
                        yield record(rows)
                        rows, held = [], 0
            if rows:
                yield record(rows)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["archive", "member", "size", "verdict", "text"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def members(archive: str, content: bytes) -> Iterator[tuple]:
        if not zipfile.is_zipfile(io.BytesIO(content)):
            yield archive, None, len(content), "not an archive", None
            return
        with zipfile.ZipFile(io.BytesIO(content)) as zipped:
            infos = [i for i in zipped.infolist() if not i.is_dir()]
            total = sum(i.file_size for i in infos)
            for i in infos:
                base = i.filename.rsplit("/", 1)[-1]
                verdict = "not allowed" if base.lower() not in allowed else "archive too large" if total > most_archive else "too large" if i.file_size > most_member else "ok"
                text = None
                if verdict == "ok":
                    try:
                        text = zipped.read(i).decode("utf-8", "replace")
                    except (RuntimeError, zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
                        verdict = "encrypted" if i.flag_bits & 1 else "damaged"
                yield archive, base, i.file_size, verdict, text
            if not infos:
                yield archive, None, 0, "empty", None

    return archives.select("path", "content").mapInArrow(read, MEMBERS)


def read_archives(
    spark: SparkSession, path: str, allowed: tuple[str, ...] = EXPORT, most_member: int = MOST_MEMBER, most_archive: int = MOST_ARCHIVE
) -> DataFrame:
    """``unpacked`` for the archives that are files in a folder."""
    return unpacked(spark.read.format("binaryFile").load(path), allowed, most_member, most_archive)


def is_export(members: DataFrame, least: int = 2) -> DataFrame:
    """Of each archive, how many of an export's files it holds and whether these are enough."""
    known = F.count_if(F.lower("member").isin(*EXPORT))
    return members.groupBy("archive").agg(known.alias("n_known"), (known >= least).alias("is_export"))


def csv_rows(members: DataFrame, member: str) -> DataFrame:
    """The records (``archive``, ``record``) of one kind of member."""
    return csv_records(members, member).select("archive", "record")


def csv_records(members: DataFrame, *kinds: str) -> DataFrame:
    """The records of some kinds of members (``kind``), in one pass, as maps by lower-case header; blank records are dropped.

    Cells beyond the header's are kept as one, joined by commas, under ``extra``; missing ones are empty, and of
    headers that are alike the last counts.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archives, kinds, rows = [], [], []
            for archive, kind, text in zip(*(batch.column(c).to_pylist() for c in ("archive", "kind", "text"))):
                for record in csv.DictReader(io.StringIO(text), restkey="extra"):
                    cells: dict[str, str] = {}
                    for k, v in record.items():
                        cells[(k or "").strip().lower().replace(" ", "_")] = (",".join(v) if isinstance(v, list) else v or "").strip()
                    if any(cells.values()):
                        archives.append(archive)
                        kinds.append(kind)
                        rows.append(list(cells.items()))
            yield pa.RecordBatch.from_arrays([pa.array(archives, pa.string()), pa.array(kinds, pa.string()), pa.array(rows, pa.map_(pa.string(), pa.string()))], ["archive", "kind", "record"])

    kind = F.lower("member")
    chosen = members.where(kind.isin(*kinds) & (F.col("verdict") == "ok")).select("archive", kind.alias("kind"), "text")
    return chosen.mapInArrow(parse, "archive string, kind string, record map<string, string>")
