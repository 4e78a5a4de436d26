"""File sources and sinks: CSV / JSON drop directories, manifest, partitioned parquet.

All paths live under the shared checkpoint folder the cluster names in
``spark.checkpoint.dir`` (a local scratch folder only when unset, in tests).
"""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import posixpath
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, *parts: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return posixpath.join(base.rstrip("/"), "limnos", *parts)


NULL_MARK = "\\N"   # distinguishes a missing value from an empty text cell
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv_dir(df: DataFrame, path: str, partition_by: str = "source_file") -> None:
    """Stage a table as a directory of CSV files (header, one folder per source)."""
    (df.write.mode("overwrite").partitionBy(partition_by).option("header", True)
     .option("nullValue", NULL_MARK).option("emptyValue", '""').csv(path))


def write_uploads(df: DataFrame, path: str, headers: dict[str, list], partition_by: str = "source_file") -> None:
    """Stage each source as CSV files with the columns of its own header."""
    for source, columns in headers.items():
        write_csv_dir(df.where(F.col(partition_by) == source).select(*columns).withColumn(partition_by, F.lit(source)), posixpath.join(path, source.partition(".")[0]), partition_by)


def _has_files(spark: SparkSession, path: str, ending: str) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    listing = fs.listFiles(p, True)
    while listing.hasNext():
        if listing.next().getPath().getName().endswith(ending):
            return True
    return False


def _empty_files(spark: SparkSession, path: str, glob: str) -> list[str]:
    fs, p = _fs(spark, path)
    found, listing = [], fs.listFiles(p, True) if fs.exists(p) else None
    while listing is not None and listing.hasNext():
        s = listing.next()
        if s.getLen() == 0 and fnmatch.fnmatch(s.getPath().getName(), glob):
            found.append(s.getPath().toString())
    return found


def _lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, start, n, value): the lines of every file, the place of their block in it and their order in the
    block; files that cannot be read give none."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value"))


def _blocks(lines: DataFrame) -> DataFrame:
    """(path, start, first, lines, header, utf8) of every block of a file: one pass with partial aggregation."""
    return lines.groupBy("path", "start").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"), F.min_by("value", "n").alias("header"),
                                              F.bool_and(F.is_valid_utf8("value")).alias("utf8"))


def header_names(line: str) -> list[str]:
    """Column names of a header line: quotes and a byte order mark removed, empty ones named by their place, a
    repeated name (in any case) with a number."""
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([line.lstrip("\ufeff")], skipinitialspace=True), [])):
        name = name or f"_c{k}"
        taken, new, again = {x.lower() for x in out}, name, 0
        while new.lower() in taken:
            again += 1
            new = f"{name}.{again}"
        out.append(new)
    return out


def csv_headers(spark: SparkSession, path: str, retry: str = "ISO-8859-1") -> DataFrame:
    """(header, encoding, paths): the files of each header line, found in one pass over the lines.

    Files with a line that is not UTF-8 are of the `retry` encoding; their headers are told apart as raw bytes."""
    files = _blocks(_lines(spark, path)).groupBy("path").agg(F.min_by("header", "start").alias("header"), F.bool_and("utf8").alias("utf8"))
    return files.groupBy("header", F.when(F.col("utf8"), "UTF-8").otherwise(retry).alias("encoding")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_csv_dir(spark: SparkSession, path: str, fallback: str | None = None, retry: str = "ISO-8859-1", multi_line: bool = False) -> DataFrame:
    """src_csv_dir: the files of a folder united by column name, every column as string (no inference), the source
    from the folder name, the file, and lines that do not fit in `_corrupt_record`.

    Files are grouped by their header line; each group is one scan with its own schema, so swapped, missing and
    additional columns land under their names, and a file without a column has nulls there.  Names that differ in
    case alone are one column, named as in the first file by path.  Files with lines that are not UTF-8 are read as
    `retry`.  Without CSV files in `path` the `fallback` folder is read.  multi_line: quoted line breaks inside cells
    (files are then not split).  A header belongs to a group of files and not to a file, so what the driver holds is
    a row a header and the list of files that any scan has."""
    if fallback is not None and not _has_files(spark, path, ".csv"):
        path = fallback
    options = dict(header=True, mode="PERMISSIVE", nullValue=NULL_MARK, emptyValue="", multiLine=multi_line, columnNameOfCorruptRecord="_corrupt_record", basePath=path)
    groups = sorted(csv_headers(spark, path, retry).collect(), key=lambda g: g.paths[0])
    parts: list[DataFrame] = []
    for g in groups:
        line = g.header
        if g.encoding != "UTF-8":  # the header once more, in the group's encoding
            line = spark.read.option("encoding", g.encoding).csv(g.paths[0], sep="\x01", quote="", header=False).limit(1).first()[0]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header_names(line), "_corrupt_record"]])
        part = spark.read.schema(schema).options(**options, encoding=g.encoding).csv(list(g.paths))
        parts.append(part.withColumn("file_path", F.col("_metadata.file_path")))
    if not parts:
        return spark.createDataFrame([], "_corrupt_record string, file_path string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


LIVE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("station_id", T.LongType()),
    T.StructField("station_no", T.StringType()), T.StructField("station_name", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()), T.StructField("parameter_raw_name", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("value", T.StringType()),
    T.StructField("unit", T.StringType()),
])


def write_json_drop(feed: DataFrame, path: str) -> None:
    """Stage the live feed as JSON files, one folder per reading day (the drop directory)."""
    (feed.withColumn("day", F.to_date("timestamp").cast("string")).write.mode("overwrite")
     .partitionBy("day").option("timestampNTZFormat", TS_FORMAT).json(path))


def read_live_json(spark: SparkSession, path: str) -> DataFrame:
    """src_live_json: declared schema, known fields only."""
    return (spark.read.schema(LIVE_SCHEMA).option("timestampNTZFormat", TS_FORMAT).json(path)
            .select(*[f.name for f in LIVE_SCHEMA.fields]))


def manifest(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """src_manifest: one row per file: name, size, rows, columns, content hash, encoding, state and parameter
    group from its name, whether an earlier file (by path) has the same content, and whether it could be read.

    Files are read as lines, in blocks as Spark cuts them.  A line's number in its file is its place in the block
    and the lines of the blocks before; the content hash combines the hashes of (number, line), so it depends on the
    order of lines and not on the cut, and no file is ever held whole.  Empty and unreadable files are Failed."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
             .load(path).select("path", "length"))  # the content is not read
    empty = _empty_files(spark, path, glob)  # no scan gives a row for these
    if empty:
        files = files.union(spark.createDataFrame([(p, 0) for p in empty], "path string, length long"))
    lines = _lines(spark, path, glob)
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _blocks(lines).withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))  # a row a block
    place = lines.join(blocks.select("path", "start", "first", "before"), ["path", "start"]).select("path", F.xxhash64(F.col("before") + F.col("n") - F.col("first"), "value").alias("h"))
    digest = place.groupBy("path").agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"))
    content = blocks.groupBy("path").agg(F.sum("lines").alias("lines"), F.min(F.struct("start", F.col("header").alias("value"))).alias("header"),
                                         F.bool_and("utf8").alias("utf8")).join(digest, "path")
    d = files.join(content, "path", "left")
    name = F.element_at(F.split("path", "/"), -1)
    source = F.regexp_extract("path", "source_file=([^/]+)/", 1)
    d = d.select(
        "path", name.alias("file_name"), F.when(source == "", name).otherwise(F.url_decode(source)).alias("source_file"),
        (F.col("length") / (1024.0 * 1024.0)).alias("file_size_mb"),
        F.greatest(F.coalesce("lines", F.lit(0)) - 1, F.lit(0)).alias("row_count"),
        F.coalesce(F.regexp_count(F.regexp_replace("header.value", '"[^"]*"', "x"), F.lit(",")) + 1, F.lit(0)).alias("column_count"),
        F.when(F.coalesce("utf8", F.lit(True)), "utf-8").otherwise("latin1").alias("detected_encoding"),
        F.sha2(F.concat_ws(":", F.coalesce("lines", F.lit(0)).cast("string"), F.col("x").cast("string"), F.col("s").cast("string")), 256).alias("content_hash"),
        F.when(F.col("lines").isNull(), "Failed").otherwise("Success").alias("load_status"))
    earlier = d.groupBy("content_hash").agg(F.min("path").alias("_first"))
    return d.join(earlier, "content_hash").select(
        "file_name", "source_file", "path", "file_size_mb", "row_count", "column_count", "detected_encoding", "content_hash",
        "load_status", (F.col("path") != F.col("_first")).alias("duplicate_file_flag"),
        X.state_from_filename("source_file").alias("inferred_state_from_filename"),
        X.group_from_filename("source_file").alias("likely_parameter_group"))


def manifest_summary(files: DataFrame) -> DataFrame:
    """Files found, failed, duplicate and new."""
    failed, again = F.col("load_status") == "Failed", F.col("duplicate_file_flag")
    return files.agg(F.count(F.lit(1)).alias("total_discovered"), F.count_if(failed).alias("failed_files"),
                     F.count_if(again).alias("excluded_hash"), F.count_if(~failed & ~again).alias("new_files"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, posixpath.join(path, "_SUCCESS"))
    return fs.exists(p)


def folder_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) below a path."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0, 0
    s = fs.getContentSummary(p)
    return s.getFileCount(), s.getLength()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def input_key(spark: SparkSession, paths) -> str:
    """A digest of the files under the paths (names, sizes, times): a table derived from them is fresh while it is the same."""
    found = []
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            continue
        listing = fs.listFiles(p, True)
        while listing.hasNext():
            s = listing.next()
            found.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()[:12]


def stage_once(spark: SparkSession, path: str, writer) -> str:
    """Materialise derived input once per location (deterministic content; reused by later runs)."""
    if not path_exists(spark, path):
        writer(path)
    return path
