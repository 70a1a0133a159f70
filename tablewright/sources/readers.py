"""Table sources (SRC1-SRC7): one ``read_any`` choosing a Spark reader by content and suffix.

Only the first ``SNIFF_BYTES`` bytes of one file reach the driver (format, header and
delimiter sniffing), and an ARFF file's lines before '@data'; the data itself is parsed by Spark's CSV/JSON/parquet/text readers in
the executors.
"""

from __future__ import annotations

import codecs
import csv
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC_PATTERN, strip_ws
from . import csv_records

# ---- fixed values -------------------------------------------------------------------------
CSV_SEPARATORS = [",", "\t", ";", "|"]          # tried in this order
OTHER_SEPARATORS = ":^~ "                       # for the sniffer, if none of those divides the header
ARFF_NULL_MARKERS = ["?", "NA", "N/A", ""]
SNIFF_LINES = 10                                # lines inspected for the ARFF signature
SNIFF_BYTES = 64 << 10
MAX_FILES = 100_000                             # ARFF files with a header each: one number a file is sent
TYPED_COLUMNS = 200                             # columns typed by one aggregate
SPREAD_BYTES = 512 << 10                        # compressed bytes worth a task of their own
SUPPORTED_SUFFIXES = [".csv", ".tsv", ".json", ".parquet", ".data", ".arff"]
UNSUPPORTED_SUFFIXES = [".xlsx", ".xls"]        # single-machine spreadsheet readers: not built
# One ARFF field: in either kind of quotes, or bare up to the next comma.
ARFF_FIELD = r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,]*?)\s*(?:,|$)"""
ARFF_NAME = re.compile(r"""@attribute\s+(?:'([^']*)'|"([^"]*)"|(\S+))""", re.I)
# -------------------------------------------------------------------------------------------


def _open_first(spark: SparkSession, path: str):
    """An input stream of the file, or of the first non-empty data file below a folder; or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    listed, files = fs.listFiles(root, True), []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() and status.getPath().getName()[0] not in "._":
            files.append(status.getPath().toString())
    return fs.open(jvm.org.apache.hadoop.fs.Path(min(files))) if files else None


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of the file, or of the first non-empty data file below a folder."""
    stream = _open_first(spark, path)
    if stream is None:
        return b""
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def head_text(spark: SparkSession, path: str) -> str:
    return head_bytes(spark, path).decode("utf-8", "replace").lstrip("\ufeff")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path)


def is_arff(spark: SparkSession, path: str) -> bool:
    """SRC7 sniff: '@relation' or '@attribute' among the first lines."""
    lines = head_text(spark, path).splitlines()[:SNIFF_LINES]
    return any(line.strip().lower().startswith(("@relation", "@attribute")) for line in lines)


def sniff_csv(sample: str) -> tuple[str, bool]:
    """SRC2: (separator, whether a quoted field holds a line break) of the first bytes.  The
    first separator that divides the header, quotes respected, wins; one that gives every
    sampled row the header's width goes before one that doesn't."""
    def rows(sep):
        found = list(csv.reader(sample.splitlines(keepends=True), delimiter=sep))
        return [r for r in found if r][:-1 if len(sample) >= SNIFF_BYTES else None]

    ragged = None
    for sep in CSV_SEPARATORS:
        found = rows(sep)
        if found and len(found[0]) >= 2:
            if len({len(r) for r in found}) == 1:
                return sep, _breaks(found)
            ragged = ragged or sep
    if ragged is None:
        try:
            ragged = csv.Sniffer().sniff(sample, OTHER_SEPARATORS).delimiter
        except csv.Error:
            ragged = ","
    return ragged, _breaks(rows(ragged))


def _breaks(rows: list[list[str]]) -> bool:
    return any("\n" in field.rstrip("\r\n") for r in rows for field in r)


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
             multi_line: bool | None = None) -> DataFrame:
    """SRC2/SRC3: CSV with the given or sniffed separator and inferred column types.

    ``multi_line``: whether quoted fields may hold line breaks.  None decides by the lines of all
    files, in one pass: a dataset with such breaks is read record by record, split by split
    (``csv_records``).  True leaves that to Spark's reader, one task a file, as is needed for files
    that end lines with CR alone."""
    found, breaks = sniff_csv(head_text(spark, path))
    sep = sep or found
    if multi_line is None and len(sep) == 1:
        inside, open_ = csv_records.inside_splits(csv_records.lines_of(spark, path), sep)
        if open_:
            return csv_records.read_records(spark, path, sep, header, inside)
    return (spark.read.option("recursiveFileLookup", "true")
            .csv(path, sep=sep, header=header, inferSchema=True, mode="PERMISSIVE", quote='"', escape='"',
                 multiLine=bool(multi_line)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: a whole-file JSON array of records (read by one task per file), or JSON lines."""
    multi = head_text(spark, path).lstrip().startswith("[")
    return spark.read.option("recursiveFileLookup", "true").json(path, multiLine=multi)


def typed(df: DataFrame) -> DataFrame:
    """String columns whose values all look numeric become doubles; one aggregate decides, or for
    wide tables one for each ``TYPED_COLUMNS`` columns (generated code has a size limit)."""
    bad = []
    for at in range(0, len(df.columns), TYPED_COLUMNS):
        bad += df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.col(f"`{c}`").rlike(NUMERIC_PATTERN)).alias(str(i))
                        for i, c in enumerate(df.columns[at:at + TYPED_COLUMNS])]).first()
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if bad[i] == 0 else F.col(f"`{c}`")
                       for i, c in enumerate(df.columns)])


def read_data_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: headerless file; comma-separated with more than one field -> col_0..col_{n-2},
    class; otherwise whitespace-separated with positional names '0', '1', ... (short rows are
    filled with NULL)."""
    df = spark.read.option("recursiveFileLookup", "true").csv(path, header=False, inferSchema=True)
    n = len(df.columns)
    if n > 1:
        return df.toDF(*[f"col_{i}" for i in range(n - 1)], "class")
    rows = _text(spark, path).select(strip_ws(F.col("value")).alias("v")).where("v <> ''")
    parts = rows.select(F.split("v", r"\s+").alias("p"))
    width = parts.agg(F.max(F.size("p"))).first()[0] or 0
    return typed(parts.select(*[F.get("p", F.lit(i)).alias(str(i)) for i in range(width)]))


def arff_header(spark: SparkSession, path: str) -> list[str]:
    """Lines up to '@data' of the first file, stripped, without blank lines and comments; read
    on block by block until '@data' comes.  A file without it has no data and raises."""
    stream, lines, rest = _open_first(spark, path), [], ""
    if stream is None:
        raise ValueError(f"{path} is empty")
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    try:
        while True:
            block = bytes(stream.readNBytes(SNIFF_BYTES))
            *whole, rest = re.split(r"\r\n|\r|\n", rest + decoder.decode(block, not block))
            for line in whole if block else [*whole, rest]:
                line = line.strip().lstrip("\ufeff")
                if line and not line.startswith("%"):
                    lines.append(line)
                if line.lower().startswith("@data"):
                    return lines
            if not block:
                raise ValueError(f"no @data section in {path}")
    finally:
        stream.close()


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: ARFF - attribute names from '@attribute' lines (quotes stripped); every line after
    '@data' is data (also one that starts with '@' or repeats a line of the header), but for '%'
    comments and blank lines, and so is every line of a file without a header of its own; fields
    in either kind of quotes, NULL markers ? NA N/A '', numeric columns typed by one aggregate."""
    header = arff_header(spark, path)
    names = [m[1] or m[2] or m[3] for m in map(ARFF_NAME.match, header) if m]
    if not names:
        raise ValueError(f"no @attribute declarations in {path}")
    data = _after_header(spark, path).where((F.col("v") != "") & ~F.col("v").startswith("%"))
    fields = data.select(F.regexp_extract_all("v", F.lit(ARFF_FIELD), 1).alias("f"))
    return typed(fields.select(*[_arff_value(F.get("f", F.lit(i))).alias(name) for i, name in enumerate(names)]))


def _after_header(spark: SparkSession, path: str) -> DataFrame:
    """(v): the stripped lines behind each file's first '@data' line, told by their place."""
    low = F.lower(strip_ws(F.col("value")))
    lines = csv_records.lines_of(spark, path)
    marks = (lines.where(low.startswith("@data") | low.startswith("@attribute")).groupBy("file")
             .agg(F.min(F.when(low.startswith("@data"), F.col("start"))).alias("data"),
                  F.min(F.when(low.startswith("@attribute"), F.col("start"))).alias("attribute"))
             .where("attribute <= data").select("file", "data").limit(MAX_FILES + 1).collect())
    if len(marks) > MAX_FILES:
        raise ValueError(f"over {MAX_FILES} files with a header below {path}")
    header_ends = {m["file"]: m["data"] for m in marks}     # file -> the split that '@data' begins in

    def behind(batches):
        split, passed = None, True
        for batch in batches:
            for file, start, part in csv_records.runs(batch):
                if split != (file, start):
                    split, passed = (file, start), start > header_ends.get(file, -1)
                if not passed and start == header_ends[file]:
                    starts = pc.starts_with(pc.utf8_lower(pc.utf8_ltrim(part, " \t\r\n\f\v\ufeff")), "@data")
                    at = pc.index(starts, True).as_py()
                    passed, part = at >= 0, part.slice(at + 1) if at >= 0 else part.slice(0, 0)
                    yield pa.RecordBatch.from_arrays([part], ["value"])
                elif passed:
                    yield pa.RecordBatch.from_arrays([part], ["value"])

    return lines.mapInArrow(behind, "value string").select(strip_ws(F.col("value")).alias("v"))


def _arff_value(raw: Column) -> Column:
    bare = strip_ws(F.regexp_replace(raw, "^['\" ]+|['\" ]+$", ""))
    return F.when(~F.trim(raw).isin(*ARFF_NULL_MARKERS) & ~bare.isin(*ARFF_NULL_MARKERS), bare)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: parquet by its magic bytes and ARFF by content first, whatever the suffix; then by
    suffix; unknown suffixes raise ValueError."""
    if head_bytes(spark, path, 4) == b"PAR1":
        return spark.read.parquet(path)
    if is_arff(spark, path):
        return read_arff(spark, path)
    low = path.lower().rstrip("/")
    if any(low.endswith(s) for s in UNSUPPORTED_SUFFIXES):
        raise ValueError(f"spreadsheet formats are not supported: {path}")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith(".tsv"):
        return read_csv(spark, path, sep="\t")
    if low.endswith(".data"):
        return read_data_file(spark, path)
    if low.endswith(".arff"):
        return read_arff(spark, path)
    if low.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than its bytes and the task slots ask for.

    A parquet file written as one row group cannot be split, so every per-row step after its
    scan would run in a single task.  Tables under ``SPREAD_BYTES`` stay as they are, larger
    ones get a partition for each such block, at most one for each slot; a scan of many files
    or row groups has enough already.  Round-robin repartitioning sorts rows first, so a
    retried task gets the same rows.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // SPREAD_BYTES)
    return df.repartition(wanted) if wanted > 1 and df.rdd.getNumPartitions() < wanted else df
