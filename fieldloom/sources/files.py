"""File inventories, JSON lines with a fixed schema, and guarded writes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .tables import written


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line; a malformed line fails the read, NaN tokens are refused."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Refuses a target that exists; a double that is not finite fails the job."""
    guarded = df
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = F.isnan(name) | (F.abs(name) == float("inf"))
            guarded = guarded.withColumn(name, F.when(bad, F.raise_error(F.lit(f"{name} is not finite"))).otherwise(F.col(name)))
    guarded.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One line of names, then the rows; refuses a target that exists. Columns have to be plain values."""
    nested = [n for n, kind in df.dtypes if kind.startswith(("array", "map", "struct", "binary"))]
    if nested:
        raise ValueError(f"columns that a CSV file can't hold: {nested}")
    df.write.mode("errorifexists").option("header", "true").csv(path)


def append_log(df: DataFrame, path: str, step: int) -> None:
    """Rows of one step of a metric log, as JSON lines in a folder of the step's number: a step that is tried again replaces its own rows only."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/step={step}")


def publish(df: DataFrame, path: str) -> None:
    """Write a table so that readers see all of it or nothing: written beside the target, then renamed to it. Refuses a target that exists; what a broken run left is replaced."""
    session = df.sparkSession
    hadoop = session._jvm.org.apache.hadoop.fs.Path
    target, building = hadoop(path), hadoop(path.rstrip("/") + ".building")
    store = target.getFileSystem(session._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(building.toString())
    if not store.rename(building, target):
        raise OSError(f"can't rename to {path}")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime, sha256, git_sha1) of every file below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    header = F.encode(F.concat(F.lit("blob "), F.octet_length("content").cast("string")), "utf-8")
    blob = F.concat(header, F.unhex(F.lit("00")), "content")
    return files.select(F.col("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.sha1(blob).alias("git_sha1"))


def stale(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, size_bytes, mtime) whose file is gone or differs, by the files' metadata only."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("now_size"), F.col("modificationTime").alias("now_mtime"))
    joined = manifest.join(now, "path", "left")
    return joined.filter(F.col("now_size").isNull() | (F.col("now_size") != F.col("size_bytes")) | (F.col("now_mtime") != F.col("mtime")))


#: Of each file that was ever read: path, size, time and digest, and the run that read it.
STATE = "path string, size_bytes long, mtime timestamp, sha256 string, run long"
#: So many changed paths go into the scan's filter one by one; beyond that their least time does.
BY_PATH = 1000
#: A task holds a file of up to so many bytes whole; a larger one passes through it in lines.
WHOLE = 64 << 20
#: A task holds a line of up to so many bytes, and batches of about so many.
LINE, BATCH = 16 << 20, 4 << 20
#: What ends a line: files that line feeds don't cut into lines below LINE are cut at runs of zeros.
LINE_FEED, ZEROS = "\n", "\0" * 64
#: Names by which Spark's reader of lines unpacks a file, whatever it holds.
PACKED = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zstd?)$"
MARK = b"\xef\xbb\xbf"  # that reader drops it at a file's start


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime) of every file below path, without opening any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("mtime"))


def known_files(spark: SparkSession, state: str) -> DataFrame:
    """(path, size_bytes, mtime, sha256): what the last run that read each file found; empty before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STATE).drop("run")
    rows = spark.read.schema(STATE).parquet(state)
    return rows.groupBy("path").agg(F.max_by(F.struct("size_bytes", "mtime", "sha256"), "run").alias("x")).select("path", "x.*")


def changed_files(spark: SparkSession, path: str, state: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime) of files that are new or whose size or time differs from the state's."""
    return listing(spark, path, pattern).join(known_files(spark, state), ["path", "size_bytes", "mtime"], "left_anti")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files_of(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, size, lines) of each file that a batch has lines of."""
    runs, begin = pc.run_end_encode(batch.column("path")), 0
    for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        yield path, batch.column("size")[begin].as_py(), batch.column("line").slice(begin, end - begin)
        begin = end


def _digest_lines(end: str, mark: bytes = b"") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(path, sha256) of files that begin with mark and whose lines after it (path, size, line) come in order, file after file. The digest is null where these don't add up to the file's size."""
    gap = end.encode()

    def row(path, size, seen, digest):
        rest = {len(mark): b"", len(mark) + len(gap): gap}.get(size - seen)  # the last line may have had its end
        if rest:
            digest.update(rest)
        return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "sha256": pa.array([None if rest is None else digest.hexdigest()], pa.string())})

    def run(batches):
        file, seen, digest = None, 0, None
        for batch in batches:
            for path, size, lines in _files_of(batch):
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), gap)[0].as_buffer()
                if file == (path, size):
                    digest.update(gap)
                    seen += len(gap)
                else:
                    if file:
                        yield row(*file, seen, digest)
                    file, seen, digest = (path, size), 0, hashlib.sha256(mark)
                digest.update(text)
                seen += len(text)
        if file:
            yield row(*file, seen, digest)

    return run


def _whole_digests(spark: SparkSession, reader: dict[str, str], path: str, chosen: Column, largest: int) -> DataFrame:
    """(path, sha256) of the chosen files, each held whole; Spark refuses those of 2 GB or more."""
    files = spark.read.format("binaryFile").options(**reader).load(path).filter(chosen)
    return files.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))


def _line_digests(end: str, mark: bytes, spark: SparkSession, reader: dict[str, str], path: str, chosen: Column, largest: int) -> DataFrame:
    """(path, sha256) of the chosen files, each read in order by one task that holds a batch of lines; null or no row where lines don't give the whole file.

    Without a mark, a file that can't be read to its end is one of these. With one, that is an error, as the lost bytes could be taken for the mark.
    """
    lines = spark.read.options(**reader).option("lineSep", end).option("ignoreCorruptFiles", str(not mark)).option("mapreduce.input.linerecordreader.line.maxlength", str(LINE)).text(path)
    told = lines.filter(chosen & ~F.col("_metadata.file_name").rlike(PACKED)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    one_task_a_file = {"spark.sql.files.maxPartitionBytes": str(largest), "spark.sql.files.openCostInBytes": str(largest)}
    with _settings(spark, {**one_task_a_file, "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)}):
        return written(told.mapInArrow(_digest_lines(end, mark), "path string, sha256 string"), "digests")


def verify_files(spark: SparkSession, path: str, state: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, mtime, sha256) of every file below path; only files that changed since the state's last run are opened.

    Their digests are appended to the state, a Parquet table outside path. The names of changed files,
    or their least time where they are many, reach the scan, which opens no other file. Files above WHOLE
    pass through a task in lines; those that don't come out whole so are cut at zeros, else held whole.
    """
    changed = written(changed_files(spark, path, state, pattern), "changed")
    sizes = changed.agg(F.min("size_bytes"), F.max("size_bytes")).first()
    if sizes[0] is not None:
        reader, above = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}, F.col("_metadata.file_size") > WHOLE
        last = 0 if len(known_files(spark, state).limit(1).collect()) == 0 else spark.read.schema(STATE).parquet(state).agg(F.max("run")).first()[0]
        ways = [(F.col("size_bytes") <= WHOLE, ~above, _whole_digests)] if sizes[0] <= WHOLE else []
        if sizes[1] > WHOLE:
            ways += [(F.col("size_bytes") > WHOLE, above, way) for way in (partial(_line_digests, LINE_FEED, b""), partial(_line_digests, ZEROS, b""), partial(_line_digests, LINE_FEED, MARK), _whole_digests)]
        for wanted, fits, digests in ways:
            left = written(changed.filter(wanted).join(known_files(spark, state), ["path", "size_bytes", "mtime"], "left_anti"), "left")
            few = [r.path for r in left.select("path").limit(BY_PATH + 1).collect()]
            if not few:
                break
            if len(few) <= BY_PATH:
                among = F.col("_metadata.file_path").isin(few)
            else:
                among = F.col("_metadata.file_modification_time") >= F.lit(left.agg(F.min("mtime")).first()[0])
            read = digests(spark, reader, path, among & fits, sizes[1]).filter("sha256 IS NOT NULL").join(left, "path")
            read.select("path", "size_bytes", "mtime", "sha256", F.lit(last + 1).cast("long").alias("run")).write.mode("append").parquet(state)
    return listing(spark, path, pattern).join(known_files(spark, state), ["path", "size_bytes", "mtime"])


def file_problems(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) between a manifest (path, split, size_bytes, sha256) and files found (path, size_bytes, sha256), each path as the other has it: missing, unlisted, truncated, size, digest, and content that files of several splits share."""
    m = manifest.select("path", "split", F.col("size_bytes").alias("ms"), F.col("sha256").alias("mh"), F.lit(True).alias("im"))
    j = m.join(found.select("path", F.col("size_bytes").alias("fs"), F.col("sha256").alias("fh"), F.lit(True).alias("here")), "path", "full")
    both = F.col("im").isNotNull() & F.col("here").isNotNull()
    rules = {"missing": F.col("here").isNull(), "unlisted": F.col("im").isNull(), "truncated": both & (F.col("fs") < F.col("ms")), "size": both & (F.col("fs") > F.col("ms")), "digest": both & (F.col("fs") == F.col("ms")) & (F.col("fh") != F.col("mh"))}
    named = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    own = j.select("path", F.explode(named).alias("problem"))
    copies = j.filter(both).groupBy("fh").agg(F.countDistinct("split").alias("splits")).filter("splits > 1").select("fh")
    return own.unionByName(j.filter(both).join(copies, "fh", "left_semi").select("path", F.lit("shared_by_splits").alias("problem")))
