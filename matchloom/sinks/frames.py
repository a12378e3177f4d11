"""csv, parquet and xlsx artefacts of result frames."""

from __future__ import annotations

import io
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark import SparkContext
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.output import computed_names, flatten, map_columns
from ..operators.resolve import public
from ..sources import files
from . import xlsx
from .xlsx import Workbook


def _single_file(df: DataFrame, path: str, fmt: str) -> None:
    """One file, in whatever file system it lies. All tasks write parts of a CSV file, without headers, into a folder beside it; the file
    system then joins them behind the header, in the order of the parts, which is the frame's. Where it can't (only some can
    without moving bytes) the parts' bytes are copied as they are. The rows of a Parquet file are one task's work."""
    jvm = df.sparkSession._jvm
    Path_ = jvm.org.apache.hadoop.fs.Path  # noqa: N806
    target = Path_(path)
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    folder = Path_(target.getParent() or Path_("."), f"_{target.getName()}.{uuid.uuid4().hex}")
    parts = lambda at: sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    try:
        if fmt == "csv":
            _write(df.limit(0).coalesce(1), Path_(folder, "head").toString(), fmt)
            _write(df, Path_(folder, "rows").toString(), fmt, header=False)
            made = parts(Path_(folder, "head"))[0]
            _join(jvm, fs, made, parts(Path_(folder, "rows")), Path_(folder, "whole"))
            made = Path_(folder, "whole")
        else:
            _write(df.coalesce(1), folder.toString(), fmt)
            made = parts(folder)[0]
        fs.delete(target, True)
        fs.rename(made, target)
        fs.delete(Path_(target.getParent(), f".{target.getName()}.crc"), False)
    finally:
        fs.delete(folder, True)


def _join(jvm, fs, head, parts: list, whole) -> None:
    """The head and the parts behind it, as one file."""
    fs.rename(head, whole)
    filled = [p for p in parts if fs.getFileStatus(p).getLen()]
    if not filled:
        return
    try:
        to = _array(jvm, filled)
        fs.concat(whole, to)
        return
    except UnsupportedOperationException:
        pass
    begin = jvm.org.apache.hadoop.fs.Path(whole.getParent(), "begin")
    fs.rename(whole, begin)
    out = fs.create(whole, True)
    try:
        for p in [begin, *filled]:
            source = fs.open(p)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def _array(jvm, paths: list):
    """Paths as Java holds an array of them."""
    out = SparkContext._active_spark_context._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        out[i] = p
    return out


def _write(df: DataFrame, folder: str, fmt: str, header: bool = True) -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        # Spark's writer trims values unless told not to.
        w.csv(folder, header=header, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"', emptyValue='""', nullValue="")
    else:
        w.parquet(folder)


def write(df: DataFrame, path: str | Path, fmt: str, single: bool = True) -> None:
    """One file by default, of parts that all tasks write; with single=False a folder of these parts."""
    to, df = str(path) if "://" in str(path) else str(Path(path).absolute()), public(df)
    if fmt in ("csv", "parquet"):
        df = flatten(df) if fmt == "csv" else df
        (_single_file if single else _write)(df, to, fmt)
    elif fmt == "xlsx":
        with Workbook(path) as book:
            table(book, "Data", df)
    else:
        raise ValueError(f"unknown output format {fmt!r}")


#: Rows of a sheet in a piece that a task writes.
PIECE_ROWS = 20_000


def table(book: Workbook, name: str, df: DataFrame, widths: Sequence[float] = (), marks: Mapping[int, Callable[[Any], int | None]] | None = None) -> None:
    """A frame as a sheet, in its order, and as further ones where it has more rows than a sheet holds. Its rows are written to the shared
    folder, where each knows its number by its file and its place in it; tasks make them XML, in compressed pieces; the driver
    copies the pieces into the archive, a buffer at a time, and sees no row."""
    spark, df = df.sparkSession, flatten(public(df))
    where, folder = pa.fs.FileSystem.from_uri(files._uri(f"{files.shared_folder(spark)}/sheet-{uuid.uuid4().hex}"))
    base, head, most = f"{files.shared_folder(spark)}/{folder.rpartition('/')[2]}", df.columns, xlsx.MAX_ROWS - 1
    try:
        df.toDF(*[f"c{i}" for i in range(len(head))]).write.parquet(f"{base}/rows")
        where.create_dir(f"{folder}/pieces", recursive=True)
        held = spark.read.parquet(f"{base}/rows")
        at = held.metadataColumn("_metadata")
        held = held.select(at["file_name"].alias("__file"), at["row_index"].alias("__row"), *held.columns)
        before = _before(held)
        made = held.rdd.mapPartitions(lambda rows: _pieces(rows, before, f"{files._uri(base)}/pieces", most, dict(marks or {}), PIECE_ROWS))
        found = sorted(made.collect())  # a row for each piece
        for k in range(max((x[0] for x in found), default=0) + 1):
            own = [x for x in found if x[0] == k]
            book.rendered(name, head, _unpacked(where, f"{folder}/pieces", own), _long(where, f"{folder}/pieces", own), widths, sum(x[3] for x in own))
    finally:
        if where.get_file_info(folder).type != pa.fs.FileType.NotFound:
            where.delete_dir(folder)


def _before(held: DataFrame) -> dict[str, int]:
    """The rows before each file's, whose names are in the order of the frame's partitions."""
    out, n = {}, 0
    for r in sorted(held.groupBy("__file").count().collect()):
        out[r["__file"]] = n
        n += r["count"]
    return out


def _pieces(rows: Iterable[Row], before: Mapping[str, int], folder: str, most: int, marks: Mapping[int, Callable], size: int) -> Iterator[tuple[int, int, str, int, bool]]:
    """(sheet, number in it, file, bytes, whether some cells are too long) of each piece of consecutive rows."""
    where, at = pa.fs.FileSystem.from_uri(folder)
    numbered = ((before[r[0]] + r[1], r[2:]) for r in rows)
    # A piece goes on while numbers do, up to a fixed number of rows, in one sheet.
    for (_, sheet, _), group in itertools.groupby(numbered, _run_of(most, size)):
        file, first, n, long = uuid.uuid4().hex, None, 0, []
        with where.open_output_stream(f"{at}/{file}.xml", compression=None) as out:
            pack = zlib.compressobj(1)
            for pos, row in group:
                first = pos % most if first is None else first
                shown = [v if v is None or isinstance(v, bool | int | float | str) else str(v) for v in row]
                xml, more = xlsx.row_xml(pos % most + 2, shown, 1, True, marks)
                data = xml.encode()
                n += len(data)
                out.write(pack.compress(data))
                long += more
            out.write(pack.flush())
        if long:
            with where.open_output_stream(f"{at}/{file}.long", compression=None) as out:
                for x in long:
                    out.write((json.dumps(x) + "\n").encode())
        yield sheet, first, file, n, bool(long)


def _run_of(most: int, size: int) -> Callable[[tuple[int, Any]], tuple[int, int, int]]:
    """A key for groups of neighbours: consecutive numbers, sheet, fixed stretch of the sheet."""
    state = {"last": None, "run": 0}

    def key(x: tuple[int, Any]) -> tuple[int, int, int]:
        if state["last"] is not None and x[0] != state["last"] + 1:
            state["run"] += 1
        state["last"] = x[0]
        return state["run"], x[0] // most, x[0] % most // size

    return key


def _unpacked(where: pa.fs.FileSystem, folder: str, pieces: Sequence[tuple]) -> Iterator[bytes]:
    for _, _, file, *_ in pieces:
        with where.open_input_stream(f"{folder}/{file}.xml", compression=None) as f:
            unpack = zlib.decompressobj()
            while data := f.read(1 << 18):
                yield unpack.decompress(data)
            yield unpack.flush()


def _long(where: pa.fs.FileSystem, folder: str, pieces: Sequence[tuple]) -> Iterator[list[Any]]:
    for _, _, file, _, some in pieces:
        if some:
            with where.open_input_stream(f"{folder}/{file}.long", compression=None) as f:
                yield from map(json.loads, io.TextIOWrapper(io.BufferedReader(f), encoding="utf-8"))


def read_table(spark: SparkSession, path: str | Path, name: str) -> DataFrame:
    """A table of a workbook in a folder that all executors see, as text: a task streams a sheet, as many rows as one holds."""
    parts, head = xlsx.parts_of(path, name), next(xlsx.rows(path, name))
    schema = pa.schema([(f"c{i}", pa.string()) for i in range(len(head))])
    text = lambda v: v if v is None or isinstance(v, str) else str(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = itertools.islice(xlsx.rows(path, parts[k]), 1, None)
                while got := list(itertools.islice(rows, PIECE_ROWS)):
                    columns = zip(*[[text(v) for v in r] + [None] * (len(head) - len(r)) for r in got])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    kinds = ", ".join(f"c{i} string" for i in range(len(head)))
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, kinds).toDF(*head)


def formats(output: Mapping[str, Any], default: str = "xlsx") -> list[str]:
    f = output.get("format") or default
    return [f] if isinstance(f, str) else list(f)


def views(output: Mapping[str, Any]) -> list[str]:
    """separate and/or merged; without the key the old emit_unmatched flag decides on the companion file alone."""
    v = output.get("matched_unmatched")
    return [] if v is None else [v] if isinstance(v, str) else list(v)


def paths(path: str | Path, fmts: Sequence[str], tag: str = "") -> dict[str, Path]:
    p = Path(path)
    if len(fmts) == 1 and not tag:
        return {fmts[0]: p}
    return {f: p.with_name(f"{p.stem}{tag}.{f}") for f in fmts}


REASONS = {"reason_code": "string", "rejection_step": "string", "best_rejected_score": "double"}


def unmatched_export(df: DataFrame, output: Mapping[str, Any]) -> DataFrame:
    """The companion of unmatched rows: under the analysis columns, with reasons, without computed columns."""
    df = df.withColumns({n: F.lit(None).cast(k) for n, k in REASONS.items() if n not in df.columns})
    return map_columns(df.drop(*computed_names(output)), output, "analysis")
