"""File, SQL and HTTP sources as DataFrames."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import shutil
import sqlite3
import ssl
import tempfile
import time
import urllib.request
import uuid
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import POS, column

#: No text has it: with it an empty quoted field stays empty and an unquoted one is null.
NO_NULL = "\x01"
FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".zip": "zip"}
TYPES = {"text/csv": "csv", "text/tab-separated-values": "tsv", "application/json": "json", "application/x-ndjson": "jsonl", "application/jsonl": "jsonl", "application/zip": "zip", "application/x-zip-compressed": "zip", "application/vnd.apache.parquet": "parquet"}
TIMEOUT_S = 300


def interpolate(value: Any) -> Any:
    """${VAR} from the environment, at any depth; unknown ones stay as they are."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, Mapping):
        return {k: interpolate(v) for k, v in value.items()}
    return [interpolate(v) for v in value] if isinstance(value, list) else value


#: Bytes that are worth a task of their own.
TASK_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer splits than there are cores (a small file in one row group) is dealt out to them, as far as its size
    is worth it. A large table has more splits than that and stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    want = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.repartition(want) if df._jdf.rdd().getNumPartitions() < want else df


def strings(df: DataFrame) -> DataFrame:
    return df.select(*[column(c).cast("string").alias(c) for c in df.columns])


def project(df: DataFrame, columns: list[str] | None) -> DataFrame:
    return df.select(*[column(c) for c in columns]) if columns else df


#: Temporary folders of local sessions without spark.checkpoint.dir, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, which spark.checkpoint.dir names. Where it is unset a local session gets
    a temporary one; on a cluster that is an error, since its machines share no temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="matchloom-shared-")
    return _local_folders[context.applicationId]


def own_folder(path: Path, label: str) -> Path:
    made = path / f"{label}-{uuid.uuid4().hex}"
    made.mkdir(parents=True)
    return made


#: Bytes of a CSV file up to which it is one task's work anyway.
WHOLE_BYTES = 32 << 20


def _bytes(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getLen() for f in fs.globStatus(at) or []) if not fs.exists(at) else fs.getContentSummary(at).getLength()


def has_quoted_lines(spark: SparkSession, path: str) -> bool:
    """Whether a field may go over a line's end: some line has an odd number of quotes. A scan in all tasks, up to the first."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(odd % 2 == 1).limit(1).isEmpty()


#: Columns that say where a row stands: its file, where its split begins (in Parquet nothing: rows are numbered there), its number.
PLACE = ("__file", "__block", "__row")


def read_format(spark: SparkSession, path: str, fmt: str, as_strings: bool = True, multiline: bool | None = None, places: bool = False) -> DataFrame:
    """multiline: whether CSV fields may go over line ends, which forbids splitting a file; None looks at large files. places: with
    the columns PLACE."""
    if fmt in ("csv", "tsv"):
        if multiline is None:
            multiline = _bytes(spark, path) <= WHOLE_BYTES or has_quoted_lines(spark, path)
        df, as_strings = spark.read.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, inferSchema=False, escape='"', multiLine=multiline, nullValue=NO_NULL), False
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt in ("json", "jsonl"):
        df = spark.read.json(path, multiLine=fmt == "json")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    out = [column(c).cast("string").alias(c) if as_strings else column(c) for c in df.columns]
    if places:
        at = df.metadataColumn("_metadata")
        block, row = (F.lit(0).cast("long"), at["row_index"]) if fmt == "parquet" else (at["file_block_start"], F.monotonically_increasing_id())
        out += [x.alias(n) for x, n in zip((at["file_path"], block, row), PLACE)]
    return df.select(*out)


#: Splits up to which their table is sent to every task.
BROADCAST_SPLITS = 200_000


def in_order(spark: SparkSession, path: str, fmt: str, **options: Any) -> DataFrame:
    """A source whose rows know their positions, by the order of its files' names and of the rows in them. Of one file Spark's splits
    are in order, and nothing is added. Of several it packs the larger first: then a column POS has the rows of all splits before, in
    the order of (file, where the split begins), plus the row's number in its split. Splits are counted when the source is opened;
    where they are others by the time it is read (the settings of splits have changed) reading fails, it doesn't renumber."""
    df = read_format(spark, path, fmt, **options)
    if len(df.inputFiles()) < 2:
        return df
    placed = read_format(spark, path, fmt, places=True, **options)
    file, block, row = PLACE
    counts = placed.groupBy(file, block).agg(F.min(row).alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    at = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).write.parquet(at)
    splits = spark.read.parquet(at)
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    inside = F.col(row) - F.col("__first")
    changed = F.raise_error(F.lit("the source's splits have changed since its rows were numbered; open it again")).cast("long")
    pos = F.when((inside >= 0) & (inside < F.col("__n")), F.col("__base") + inside).otherwise(changed)
    return placed.join(splits, [file, block], "left").select(*[column(c) for c in df.columns], pos.alias(POS))


def load_file(spark: SparkSession, spec: Mapping[str, Any], base_dir: str = ".", **_: Any) -> DataFrame:
    """CSV, TSV, JSON and Parquet by suffix. Parquet keeps its types; the rest is text."""
    file = spec["file"]
    path = file if "://" in file else f"{str(base_dir).rstrip('/')}/{file}" if "://" in str(base_dir) else str(Path(base_dir, file))
    fmt = spec.get("format") or FORMATS.get(Path(file).suffix.lower(), "csv")
    df = in_order(spark, path, fmt, as_strings=fmt != "parquet", multiline=spec.get("multiline"))
    columns = spec.get("columns")
    return project(df, [*columns, POS] if columns and POS in df.columns else columns)


#: Rows that a task hands on at a time.
ROWS = 50_000


def _sqlite(spark: SparkSession, spec: Mapping[str, Any], base_dir: str) -> DataFrame:
    """A database in a file that the executors see as the other files of base_dir. A task queries it and hands rows on as they come; with
    a partition (column, count) several do, each those rows whose column has its remainder."""
    path = str(Path(base_dir, spec["connection"].get("database") or spec["connection"].get("path")).absolute())
    query = spec["query"].strip().rstrip(";")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [d[0] for d in db.execute(f"SELECT * FROM ({query}) LIMIT 0").description]
    split = spec.get("partition") or {}
    count = int(split.get("count", 1)) if split else 1
    schema = pa.schema([(n, pa.string()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                # A null key has no remainder and goes to the first.
                only = f" WHERE coalesce(abs(CAST(\"{split['column']}\" AS INTEGER)) % {count}, 0) = {k}" if split else ""
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as own:
                    cursor = own.execute(f"SELECT * FROM ({query}){only}")
                    while got := cursor.fetchmany(ROWS):
                        columns = [[None if v is None else str(v) for v in c] for c in zip(*got, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    kinds = ", ".join(f"`{n}` string" for n in names)
    read = spark.range(0, count, 1, count).mapInArrow(rows, kinds)
    at = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
    read.write.parquet(at)  # once, for all its readers
    return spark.read.schema(kinds).parquet(at)


def _uri(path: str) -> str:
    return f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path


def jdbc_options(spec: Mapping[str, Any]) -> dict[str, str]:
    """The reader's options for a query to Postgres, Trino, or any database whose url and driver_class the connection names."""
    c, kind = spec["connection"], spec["driver"].lower()
    options = {"user": str(c.get("user", "")), "fetchsize": str(spec.get("fetch_size", 10_000))}
    p = spec.get("partition")
    if p and "lower" in p:  # column, lower, upper, count: so many queries side by side, a range each
        options |= {"dbtable": f"({spec['query']}) q", "partitionColumn": str(p["column"]), "lowerBound": str(p["lower"]), "upperBound": str(p["upper"]), "numPartitions": str(p["count"])}
    elif not p:
        options["query"] = spec["query"]
    if c.get("password"):
        options["password"] = str(c["password"])
    if kind in ("postgres", "postgresql"):
        url, driver = f"jdbc:postgresql://{c['host']}:{c.get('port', 5432)}/{c['database']}", "org.postgresql.Driver"
        if c.get("sslmode"):
            url += f"?sslmode={c['sslmode']}"
    elif kind == "trino":
        url = f"jdbc:trino://{c['host']}:{c.get('port', 8080)}/{c.get('catalog', '')}/{c.get('schema', '')}".rstrip("/")
        params = []
        if c.get("http_scheme", "http") == "https" or c.get("password"):
            params.append("SSL=true")
            if c.get("verify") is False:
                params.append("SSLVerification=NONE")
        # Results come in spools unless the environment says otherwise.
        spool = os.environ.get("TRINO_SPOOLING_ENABLED", "true").lower() in ("1", "true", "yes", "on")
        if props := {"spooling_enabled": str(spool).lower()} | dict(c.get("session_properties") or {}):
            params.append("sessionProperties=" + ";".join(f"{k}:{v}" for k, v in props.items()))
        url, driver = url + ("?" + "&".join(params) if params else ""), "io.trino.jdbc.TrinoDriver"
    elif kind == "jdbc":
        url, driver = c["url"], c["driver_class"]
    else:
        raise ValueError(f"unknown SQL driver {spec['driver']!r}; known: sqlite, postgresql, trino, jdbc")
    if unresolved := [k for k, v in c.items() if isinstance(v, str) and re.search(r"\$\{\w+\}", v)]:
        raise ValueError(f"these connection settings need environment variables that aren't set: {', '.join(unresolved)}")
    return options | {"url": url, "driver": driver}


def quantile_splits(column: str, bounds: Sequence[Any]) -> list[str]:
    """Conditions that each row meets one of: ranges between the bounds, and null."""
    cuts = sorted(set(bounds))
    if not cuts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]}", *inner, f"{column} >= {cuts[-1]}", f"{column} IS NULL"]


def _split_by_quantiles(spark: SparkSession, spec: Mapping[str, Any], split: Mapping[str, Any]) -> DataFrame:
    """A query read side by side without bounds by hand: a first query fetches the numbers of the split column alone (or of `sample`, a
    query of its own that returns some of them), their quantiles cut as many ranges of like many rows as `count` says, and each range
    and the null keys are a query each. A skewed key thus has narrow ranges where its rows are."""
    options = jdbc_options(spec)
    count = int(split["count"])
    asked = split.get("sample") or f"SELECT {split['column']} FROM ({spec['query']}) q"
    keys = spark.read.format("jdbc").options(**options, query=asked).load()
    key = column(keys.columns[0])
    if keys.schema[0].dataType.simpleString() in ("string", "boolean", "date") or keys.schema[0].dataType.simpleString().startswith("timestamp"):
        raise ValueError(f"the split column {split['column']!r} isn't a number; give lower and upper")
    shares = [k / count for k in range(1, count)]
    bounds = keys.agg(F.percentile_approx(key, shares, 10_000).alias("b")).first()["b"] if shares else []
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], f"({spec['query']}) q", predicates=quantile_splits(split["column"], bounds or []), properties=rest)


def load_sql(spark: SparkSession, spec: Mapping[str, Any], base_dir: str = ".", **_: Any) -> DataFrame:
    """A query's rows as text, null kept."""
    spec = {**spec, "connection": interpolate(dict(spec.get("connection") or {}))}
    if spec.get("driver", "").lower() == "sqlite":
        df = _sqlite(spark, spec, base_dir)
    elif (p := spec.get("partition")) and "lower" not in p:
        df = strings(_split_by_quantiles(spark, spec, p))
    else:
        df = strings(spark.read.format("jdbc").options(**jdbc_options(spec)).load())
    return project(df, spec.get("columns"))


def json_path(data: Any, path: str) -> Any:
    """What stands at a.b[0].c in nested data."""
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        try:
            data = data[int(index)] if index else data[name]
        except (KeyError, IndexError, TypeError):
            raise ValueError(f"nothing at {path!r}: {name or index} is missing") from None
    return data


def detect_format(url: str, content_type: str | None = None) -> str:
    suffix = Path(url.split("?")[0].split("#")[0]).suffix.lower()
    return FORMATS.get(suffix) or TYPES.get((content_type or "").split(";")[0].strip().lower(), "csv")


def unzip(data: bytes | BinaryIO, entry: str | None = None) -> tuple[BinaryIO, str]:
    """The named entry, the only one, or the largest, as a stream; its format by its suffix."""
    z = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
    files = [i for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX")]
    if entry and entry not in {i.filename for i in files}:
        raise ValueError(f"the archive has no entry {entry!r}; it has {', '.join(i.filename for i in files)}")
    if not files:
        raise ValueError("the archive is empty")
    name = entry or max(files, key=lambda i: i.file_size).filename
    return z.open(name), FORMATS.get(Path(name).suffix.lower(), "csv")


Fetch = Callable[[str, Mapping[str, str], bool, float], tuple[bytes | BinaryIO, str]]


def fetch(url: str, headers: Mapping[str, str], verify: bool, timeout: float) -> tuple[BinaryIO, str]:
    """Body, as a stream, and content type; redirects are followed."""
    if not url.startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    context = None if verify else ssl._create_unverified_context()
    r = urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=timeout, context=context)  # noqa: S310
    return r, r.headers.get("Content-Type", "")


def _stream(body: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(body) if isinstance(body, bytes) else body


def parse_ttl(text: str | None) -> float | None:
    """Seconds of 30s, 5m, 24h or 7d; None for off."""
    text = str(text if text is not None else "24h").strip().lower()
    if text in ("off", "none", "0", "false"):
        return None
    if not (m := re.fullmatch(r"(\d+(?:\.\d+)?)([smhd])", text)):
        raise ValueError(f"unknown cache time {text!r}")
    return float(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def cache_key(spec: Mapping[str, Any]) -> str:
    """Of what the rows depend on; a password is not part of it."""
    connection = {k: v for k, v in (spec.get("connection") or {}).items() if k != "password"}
    parts = {"driver": spec.get("driver"), "connection": connection, "query": spec.get("query"), "url": spec.get("url"), "url_from": spec.get("url_from")}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:8]


def cache_path(spec: Mapping[str, Any], base_dir: str, recipe: str = "", source: str = "") -> Path:
    safe = "_".join(re.sub(r"\W+", "_", x) for x in (recipe, source) if x)
    return Path(base_dir, ".cache", f"{safe + '_' if safe else ''}{cache_key(spec)}.{'csv' if spec.get('cache_format') == 'csv' else 'parquet'}")


def _fetch_into(folder: str, get: Fetch, url: str, headers: Mapping[str, str], verify: bool, timeout: float, given: str | None, entry_name: str | None) -> tuple[str, str]:
    """The file behind an address, or an archive's entry, as a file in the folder; its format and its place."""
    body, kind = get(url, headers, verify, timeout)
    fmt = given or detect_format(url, kind)
    with _stream(body) as stream, tempfile.SpooledTemporaryFile(max_size=16 << 20) as held:
        head = stream.read(4)
        if fmt == "zip" or head == b"PK\x03\x04":
            held.write(head)
            shutil.copyfileobj(stream, held)  # only an archive needs to be read out of order
            entry, inner = unzip(held, entry_name)
            fmt = inner if fmt == "zip" else fmt
            head, stream = b"", entry
        where, at = pa.fs.FileSystem.from_uri(f"{_uri(folder)}/{uuid.uuid4().hex}")
        where.create_dir(at, recursive=True)
        with where.open_output_stream(f"{at}/body.{fmt}") as out:
            out.write(head)
            while part := stream.read(1 << 20):
                out.write(part)
    return fmt, f"{folder}/{at.rpartition('/')[2]}/body.{fmt}"


def load_http(spark: SparkSession, spec: Mapping[str, Any], base_dir: str = ".", get: Fetch = fetch, **_: Any) -> DataFrame:
    """A file from the web, streamed by a task into the folder that all executors share and read by Spark; its rows as text. An archive is
    staged beside the task, and its entry streamed on."""
    spec = interpolate(dict(spec))
    verify, timeout = spec.get("verify", True), float(spec.get("timeout", TIMEOUT_S))
    url = spec.get("url")
    if source := spec.get("url_from"):
        with _stream(get(source["endpoint"], source.get("headers") or {}, verify, timeout)[0]) as answer:
            url = json_path(json.loads(answer.read()), source["json_path"])
    folder, entry_name, given = f"{shared_folder(spark)}/http-{uuid.uuid4().hex}", spec.get("zip_entry"), spec.get("format")
    headers = spec.get("headers") or {}

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                fmt, at = _fetch_into(folder, get, url, headers, verify, timeout, given, entry_name)
                yield pa.RecordBatch.from_pydict({"fmt": [fmt], "at": [at]})

    # A task fetches it, under a name of its own for each attempt.
    got = spark.range(0, 1, 1, 1).mapInArrow(fetched, "fmt string, at string").first()
    at, fmt = got["at"], got["fmt"]
    return project(strings(read_format(spark, at, fmt)), spec.get("columns"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"file": load_file, "sql": load_sql, "http": load_http}


def load(spark: SparkSession, spec: Mapping[str, Any], base_dir: str = ".", recipe: str = "", source: str = "", positions: bool = False, **options: Any) -> DataFrame:
    """A source by its loader. SQL and HTTP results are kept for their cache time. positions: with the column POS where rows of
    several files have one."""
    kind = spec.get("loader") or ("file" if "file" in spec else None)
    if kind not in LOADERS:
        raise ValueError(f"unknown loader {kind!r}; known: {', '.join(LOADERS)}")
    ttl = None if kind == "file" else parse_ttl(spec.get("cache_ttl"))
    if ttl is None:
        df = LOADERS[kind](spark, spec, base_dir, **options)
    else:
        path = cache_path(spec, base_dir, recipe, source)  # of a base_dir that all executors see, as its files are
        if not _fresh(path, ttl):
            _cache(LOADERS[kind](spark, spec, base_dir, **options), path)
        df = in_order(spark, str(path), path.suffix[1:], as_strings=False)
    return df if positions else df.drop(POS)


def _fresh(path: Path, ttl: float) -> bool:
    """Whether the cache is young, and was written to its end: Spark's mark comes last."""
    done = path / "_SUCCESS"
    return done.exists() and time.time() - done.stat().st_mtime <= ttl


def _cache(df: DataFrame, path: Path) -> None:
    """Written beside the old one, which is replaced at the end: a write that dies leaves the cache as it was."""
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    try:
        if path.suffix == ".csv":
            df.write.csv(str(beside), header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        else:
            df.write.parquet(str(beside))
        old = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        if path.exists():
            path.rename(old)
        beside.rename(path)
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(beside, ignore_errors=True)
