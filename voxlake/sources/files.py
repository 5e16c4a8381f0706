"""File catalogs and volume headers."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.functions.text import base_name, case_id_from_name
from voxlake.schemas import HEADER

# Header type names that mean an unsigned byte.
BYTE_TYPES = ("uchar", "unsigned char", "uint8", "uint8_t")
READ_BYTES = 65_536
LENGTHS = "path STRING, length LONG"
# folders that Spark does not read
HIDDEN = re.compile(r"\.|_(?!.*=)")


def _under(root: str, recursive: bool) -> Iterator[tuple[str, int | None]]:
    """(path, length) of the volumes in a folder; its folders come without a length if not ``recursive``.

    Folders are read one after the other. Hidden ones are left out, as Spark leaves them out.
    """
    local = re.match(r"file:/*(?=/)", root)  # a local name may hold what a URI may not
    filesystem, inner = (fs.LocalFileSystem(), root[local.end() :]) if local else fs.FileSystem.from_uri(root)
    named = re.compile(r"(DATA|MASK)_.*\.nrrd", re.DOTALL).fullmatch
    infos, folders = [filesystem.get_file_info(inner)], []
    while True:
        for info in infos:
            path = root + info.path[len(inner) :]
            if info.type == fs.FileType.File and named(info.base_name):
                yield path, info.size
            elif info.type == fs.FileType.Directory:
                if recursive or path == root:
                    folders.append(info.path)
                elif not HIDDEN.match(info.base_name):
                    yield path, None
        if not folders:
            return
        infos = filesystem.get_file_info(fs.FileSelector(folders.pop()))
        infos = [i for i in infos if i.type == fs.FileType.File or not HIDDEN.match(i.base_name)]


def _listed_under(recursive: bool):
    """Arrow function: folders (path) to (path, length) of what ``_under`` finds."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64())])
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = _under(folder, recursive)
                while some := list(islice(rows, READ_BYTES)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return listed


def _roots(spark: SparkSession, root: str) -> list[str]:
    """Whole names of what ``root`` (perhaps a glob) stands for; none if Arrow does not know the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    filesystem = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = filesystem.globStatus(filesystem.makeQualified(path)) or []
    roots = [status.getPath().toString() for status in found]
    try:
        if roots and not roots[0].startswith("file:"):
            fs.FileSystem.from_uri(roots[0])
    except pa.ArrowInvalid:
        return []
    return roots


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, kind, case_id) of all volume and mask files below ``root``.

    Tasks list them, a folder in the root with all below by one, so the driver holds no names. On file
    systems that only Spark knows, its planner lists them. The case number is parsed as an integer, so
    any zero padding and any nesting fits.
    """
    if roots := _roots(spark, root):
        names = F.explode(F.array(*map(F.lit, roots)))
        top = spark.range(1).select(names.alias("path")).mapInArrow(_listed_under(False), LENGTHS)
        cores = spark.sparkContext.defaultParallelism
        folders = top.where("length IS NULL").select("path").repartition(cores, "path")
        listed = top.where("length IS NOT NULL").unionByName(folders.mapInArrow(_listed_under(True), LENGTHS))
    else:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "{DATA,MASK}_*.nrrd")
            .load(root)
            .select("path", "length")
        )
    return listed.withColumn("kind", F.substring_index(base_name(F.col("path")), "_", 1)).withColumn(
        "case_id", case_id_from_name(F.col("path"))
    )


def _vectors(text: str) -> list[list[float]]:
    groups = re.findall(r"\(([^)]*)\)", text)
    if not groups and text != "none":
        raise ValueError(text)
    return [[float(v) for v in group.split(",")] for group in groups]


# the fields that are read: name in the file, column, and what it is made of
_FIELDS = (
    ("dimension", "dim", int),
    ("sizes", "sizes", lambda v: [int(n) for n in v.split()]),
    ("space directions", "directions", _vectors),
    ("space origin", "origin", lambda v: next(iter(_vectors(v)), None)),
    ("type", "dtype", lambda v: "uint8" if v in BYTE_TYPES else v),
)


def parse_header(text: str) -> dict:
    """Fields of a volume's text header (up to its first empty line), and its ``problem``.

    A field that is absent is None; one that cannot be read is None and named by the problem.
    """
    fields = {}
    for line in text.splitlines():
        if not line.strip():
            break
        name, found, value = line.partition(":")
        if found and not line.startswith("#"):
            fields[name.strip().lower()] = value.strip()
    out, bad = {}, []
    for name, column, made in _FIELDS:
        out[column] = None
        if name in fields:
            try:
                out[column] = made(fields[name])
            except ValueError:
                bad.append(name)
    if not fields:
        bad.append("whole header")
    out["problem"] = f"malformed {', '.join(bad)}" if bad else None
    return out


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


def open_path(uri: str):
    """Byte stream of a file on any file system the workers know."""
    filesystem, path = fs.FileSystem.from_uri(_uri(uri))
    return filesystem.open_input_stream(path)


def write_file(uri: str, data: bytes) -> None:
    """A small file on any file system the workers know; folders are made as needed."""
    filesystem, path = fs.FileSystem.from_uri(_uri(uri))
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path) as stream:
        stream.write(data)


def _leading_text(uri: str) -> str:
    """The file up to its first empty line, however long that part is."""
    held = bytearray()
    with open_path(uri) as stream:
        while chunk := stream.read(READ_BYTES):
            seen = max(0, len(held) - 3)
            held += chunk
            if end := re.compile(rb"\r?\n\r?\n").search(held, seen):
                return held[: end.start()].decode("latin-1")
    return held.decode("latin-1")


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [{"path": p, **parse_header(_leading_text(p))} for p in batch["path"]]
        yield pd.DataFrame(rows, columns=HEADER.fieldNames())


def read_headers(files: DataFrame) -> DataFrame:
    """Header fields of each file; a file is read up to the end of its header."""
    return files.select("path").mapInPandas(_read_batches, HEADER)


# --- small documents, listed and read by tasks ------------------------------

#: documents of one batch
BATCH_DOCUMENTS = 64


def _matching(segment: str):
    """Arrow function: folders to the paths in them whose name fits ``segment`` of a glob."""
    fits = re.compile(fnmatch.translate(segment)).match

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                filesystem, path = fs.FileSystem.from_uri(_uri(folder))
                if filesystem.get_file_info(path).type != fs.FileType.Directory:
                    continue
                infos = filesystem.get_file_info(fs.FileSelector(path))
                names = sorted(i.base_name for i in infos if fits(i.base_name) and i.base_name[0] not in "._")
                for at in range(0, len(names), READ_BYTES):
                    found = [f"{folder}/{n}" for n in names[at : at + READ_BYTES]]
                    yield pa.RecordBatch.from_pydict({"path": pa.array(found, pa.string())})

    return listed


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for at in range(0, len(paths), BATCH_DOCUMENTS):
            rows = []
            for path in paths[at : at + BATCH_DOCUMENTS]:
                filesystem, inner = fs.FileSystem.from_uri(_uri(path))
                if filesystem.get_file_info(inner).type == fs.FileType.File:
                    with filesystem.open_input_stream(inner) as stream:
                        rows.append((stream.read().decode("utf-8", "replace"), path))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["value", "path"])


def read_documents(spark: SparkSession, glob: str) -> DataFrame:
    """(value, path) of the small files that fit ``glob`` (wildcards ``*``, ``?`` and ``[]``), hidden ones left out.

    Tasks list the folders, level by level, and read the files, so the driver holds nothing that
    grows with their number; a folder's own names are listed by one task. It is an error if no
    file fits.
    """
    segments = _uri(glob).split("/")
    wild = [bool(re.search(r"[*?\[]", s)) for s in segments]
    first = wild.index(True) if any(wild) else len(segments)
    paths = spark.range(1).select(F.lit("/".join(segments[:first])).alias("path"))
    for segment, is_wild in zip(segments[first:], wild[first:], strict=True):
        if is_wild:
            paths = paths.mapInArrow(_matching(segment), "path STRING").repartition("path")
        else:
            paths = paths.select(F.concat("path", F.lit(f"/{segment}")).alias("path"))
    documents = paths.mapInArrow(_read_documents, "value STRING, path STRING")
    if documents.isEmpty():
        raise FileNotFoundError(f"no file fits {glob}")
    return documents


# --- a data source of headers -----------------------------------------------

#: what opening a file counts for, in bytes, when files are dealt to tasks
OPEN_BYTES = 1 << 20
PARTITION_BYTES = 128 << 20
# beyond so many tasks each takes up to so many files: a small task costs more than its files
MANY_TASKS, TASK_FILES = 512, 8_192
BATCH_FILES = 256
VOLUME_NAME = re.compile(r"^(DATA|MASK)_(\d+)\.nrrd$")

VOLUME = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("case_id", T.LongType()),
        *(f for f in HEADER.fields if f.name != "path"),
    ]
)


LISTED = T.StructType(VOLUME.fields[:4])


def _cost(length: int) -> int:
    return min(length, READ_BYTES) + OPEN_BYTES


def task_count(files: int, cost: int, partition_bytes: int) -> int:
    """Tasks for ``files`` that cost so many bytes in all."""
    by_bytes = -(-cost // partition_bytes)
    return max(1, min(by_bytes, max(MANY_TASKS, -(-files // TASK_FILES))))


def _volumes_in(root: str, recursive: bool) -> Iterator[tuple[str, int, str | None, int | None]]:
    """(path, length, kind, case number) of the volumes in a folder; its folders come without a kind if not ``recursive``."""
    filesystem, inner = fs.FileSystem.from_uri(_uri(root))
    for info in filesystem.get_file_info(fs.FileSelector(inner, recursive=recursive)):
        # the same scheme as the root's
        path = root.rstrip("/") + info.path[len(inner.rstrip("/")) :]
        if info.type == fs.FileType.Directory:
            if not recursive:
                yield path, 0, None, None
        elif info.type == fs.FileType.File and (named := VOLUME_NAME.match(info.base_name)):
            yield path, info.size, named[1], int(named[2])


def _listing(recursive: bool):
    """Arrow function: folders (path) to the volumes in them."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(LISTED)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = _volumes_in(folder, recursive)
                while some := list(islice(rows, READ_BYTES)):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return listed


def _header_rows(files: list[tuple[str, int, str, int]]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(VOLUME)
    for at in range(0, len(files), BATCH_FILES):
        rows = []
        for path, length, kind, case_id in files[at : at + BATCH_FILES]:
            row = {"path": path, "length": length, "kind": kind, "case_id": case_id}
            try:
                row |= parse_header(_leading_text(path))
            except OSError as error:
                row["problem"] = f"not readable: {type(error).__name__}"
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _read_volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _header_rows(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))


@dataclass
class FileBundle(InputPartition):
    """Files that one task reads: path, length, kind and case number of each."""

    files: list[tuple[str, int, str, int]]


class VolumeReader(DataSourceReader):
    """Lists the files once, deals them to tasks by bytes, and reads headers in the tasks."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[FileBundle]:
        files = list(_volumes_in(self.root, recursive=True))
        count = task_count(len(files), sum(_cost(f[1]) for f in files), self.bytes)
        return [FileBundle(files[k::count]) for k in range(count)]

    def read(self, partition: FileBundle) -> Iterator[pa.RecordBatch]:
        yield from _header_rows(partition.files)


class VolumeSource(DataSource):
    """``spark.read.format("volume_headers").load(root)``: a row for each volume and mask file below
    ``root`` with its header's fields; ``problem`` says what of a header cannot be read.

    ``partitionBytes`` bounds what one task reads; a file counts for its header's first bytes and
    for its opening.
    """

    @classmethod
    def name(cls) -> str:
        return "volume_headers"

    def schema(self) -> T.StructType:
        return VOLUME

    def reader(self, schema: T.StructType) -> VolumeReader:
        return VolumeReader(self.options)


def read_volumes(spark: SparkSession, root: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of ``VolumeSource`` below ``root``, listed by tasks: the driver holds no names.

    The root's own names are listed by one task, and each folder in it, with all below, by another.
    """
    top = spark.range(1).select(F.lit(root).alias("path")).mapInArrow(_listing(False), LISTED)
    folders = top.where("kind IS NULL").select("path")
    cores = spark.sparkContext.defaultParallelism
    inner = folders.repartition(cores, "path").mapInArrow(_listing(True), LISTED)
    files = top.where("kind IS NOT NULL").unionByName(inner)
    cost = F.least("length", F.lit(READ_BYTES)) + F.lit(OPEN_BYTES)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(cost), F.lit(0))).first()
    return files.repartition(task_count(n, total, partition_bytes)).mapInArrow(_read_volumes, VOLUME)
