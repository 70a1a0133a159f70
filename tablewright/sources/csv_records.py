"""CSV with line breaks inside quoted fields, read by many tasks (SRC2).

Spark's CSV reader takes such a file whole in one task, because a split cannot tell whether it
begins inside a quoted field.  Here the lines are read by as many tasks as there are splits:

1. A line is a step of a machine with two states, outside and inside a quoted field.  Its step is
   one of four functions - stay, swap, always outside, always inside - told by a pattern from the
   line alone, and the steps of a split compose to one of the same four.  A first pass gives one
   row for each split; composed in the order of a file they tell which splits begin inside.
2. A second pass goes through every split from the state it begins in and joins lines to records.
   What begins in one split and ends in a later one comes out as fragments, at most two a split,
   which are put together by file and place.

The records are then parsed by Spark's own CSV parser, one record a row, so separators, quotes,
types and malformed rows follow the rules of any other file.  A quote counts only where CSV gives
it a meaning: one inside an unquoted field (``5" pipe``) is text and changes no state.

Results: blank records are skipped; records keep their inner line breaks, LF or CRLF, as they are;
files are read each from its own beginning, and with ``header`` the first record of each is left
out; a field that is never closed runs to the end of its file, but over ``MAX_RECORD`` characters
it is a ValueError instead of a task that holds the rest of the file; an empty path gives no
records.  Files that end lines with CR alone have one line here and are left to the plain reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_RECORD = 64 << 20
MAX_INSIDE = 4 << 20        # splits that may begin inside a field: 8 bytes each are sent to all tasks
STAY, SWAP, OUTSIDE, INSIDE = range(4)


def step_patterns(sep: str) -> tuple[str, str]:
    """Patterns of the lines that end inside a quoted field if they begin outside, or inside."""
    s = re.escape(sep)
    text = '[^"]*(?:""[^"]*)*'                          # of a quoted field
    plain = f'(?:[^"{s}][^{s}]*)?'
    fields = f'(?:(?:{plain}|"{text}"(?:[^"{s}][^{s}]*)?){s})*'
    outside = f'^{fields}"{text}$'
    return outside, f'^{text}$|^{text}"(?:[^"{s}][^{s}]*)?{s}{fields}"{text}$'


def steps(lines: pa.Array, patterns: tuple[str, str]) -> np.ndarray:
    """The function (STAY .. INSIDE) of each line; lines without a quote stay as they are."""
    out = np.full(len(lines), STAY, np.int8)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        # a closing CR is not part of the last field
        some = pc.utf8_rtrim(lines.take(pa.array(quoted)), "\r")
        a, b = (pc.match_substring_regex(some, p).to_numpy(zero_copy_only=False) for p in patterns)
        out[quoted] = np.select([~a & b, a & ~b, ~a & ~b], [STAY, SWAP, OUTSIDE], INSIDE)
    return out


def states(functions: np.ndarray, begin: int) -> np.ndarray:
    """The state (1: inside) after each line: the last line with a fixed outcome decides, and the
    swaps after it."""
    at = np.arange(len(functions))
    last = np.maximum.accumulate(np.where(functions >= OUTSIDE, at, -1)) if len(at) else at
    swaps = np.cumsum(functions == SWAP)
    known = last >= 0
    base = np.where(known, functions[last] == INSIDE, begin)
    return (base + swaps - np.where(known, swaps[last], 0)) % 2


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): lines with the file and split they begin in, in order within a split."""
    return (spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
            .select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """Consecutive lines of one split: (file, start, lines)."""
    file, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield int(file[a]), int(start[a]), batch.column("value").slice(a, b - a)


def inside_splits(lines: DataFrame, sep: str) -> tuple[np.ndarray, bool]:
    """(hashes of the splits that begin inside a quoted field, whether any line ends inside one)."""
    patterns = step_patterns(sep)

    def compose(batches):
        key, ends, open_ = None, (0, 1), False
        for batch in batches:
            out = []
            for file, start, part in runs(batch):
                if key is not None and key != (file, start):
                    out.append((*key, *ends, open_))
                    ends, open_ = (0, 1), False
                key, f = (file, start), steps(part, patterns)
                after = states(f, 0), states(f, 1)
                open_ |= bool(after[ends[0]].any())
                ends = int(after[ends[0]][-1]), int(after[ends[1]][-1])
            yield _table(out, ["file", "start", "out", "in", "open"], "lliib")
        if key is not None:
            yield _table([(*key, *ends, open_)], ["file", "start", "out", "in", "open"], "lliib")

    def begin(batches):
        file, state = None, 0
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, state = row["file"], 0
                found.append((row["id"], state, row["open"] or state == 1))
                state = row["in"] if state else row["out"]
            yield _table(found, ["id", "state", "open"], "lib")

    splits = lines.mapInArrow(compose, "file long, start long, out int, in int, open boolean")
    ordered = (splits.withColumn("id", F.xxhash64("file", "start")).repartition("file").sortWithinPartitions("file", "start"))
    begun = ordered.mapInArrow(begin, "id long, state int, open boolean")
    facts = begun.agg(F.count_if("open").alias("open"),
                      F.collect_list(F.when(F.col("state") == 1, F.col("id"))).alias("inside")).first()
    if len(facts["inside"]) > MAX_INSIDE:
        raise ValueError(f"over {MAX_INSIDE} splits begin inside a quoted field")
    return np.sort(np.array(facts["inside"], np.int64)), facts["open"] > 0


def _table(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    types = {"l": pa.int64(), "i": pa.int32(), "b": pa.bool_(), "s": pa.string()}
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for c, k in zip(columns, kinds)], names)


RECORD, HEAD, MIDDLE, TAIL = range(4)   # of a split's own; the end, part and beginning of a longer one


class _Joiner:
    """Lines of one split to records and fragments."""

    def __init__(self, file: int, start: int, inside: bool, patterns):
        self.file, self.start, self.patterns = file, start, patterns
        self.state, self.kept, self.size = int(inside), [], 0
        self.began_inside = inside      # and its first record has not ended yet
        self.first = start == 0         # the next record is the file's first

    def add(self, lines: pa.Array) -> list[tuple]:
        """(text, kind, first, file, start) of what ends among these lines."""
        after = states(steps(lines, self.patterns), self.state)
        out, texts, at = [], lines.to_pylist(), 0
        for end in (np.flatnonzero(after == 0) + 1).tolist():
            parts = self.kept + texts[at:end] if self.kept else texts[at:end]
            out.append((parts[0] if len(parts) == 1 else "\n".join(parts), HEAD if self.began_inside else RECORD,
                        self.first, self.file, self.start))
            self.first = self.first and out[-1][0].strip("\r\n\ufeff ") == ""
            self.kept, self.size, self.began_inside, at = [], 0, False, end
        if at < len(texts):
            self.kept += texts[at:]
            self.size += sum(map(len, texts[at:]))
            if self.size > MAX_RECORD:
                raise ValueError(f"a quoted field of over {MAX_RECORD} characters: is its quote closed?")
        self.state = int(after[-1])
        return out

    def rest(self) -> list[tuple]:
        if not self.kept:
            return []
        return [("\n".join(self.kept), MIDDLE if self.began_inside else TAIL, self.first, self.file, self.start)]


def records(spark: SparkSession, path: str, sep: str, inside: np.ndarray | None = None) -> DataFrame:
    """(value, first): the CSV records below ``path``, ``first`` where one opens its file."""
    patterns = step_patterns(sep)
    lines = lines_of(spark, path)
    if inside is None:
        inside, _ = inside_splits(lines, sep)
    sent = spark.sparkContext.broadcast(inside)
    names = ["value", "kind", "first", "file", "start"]

    def join(batches):
        joiner = None
        for batch in batches:
            out = []
            for (file, start, part), key in zip(runs(batch), _ids(batch)):
                if joiner is None or (joiner.file, joiner.start) != (file, start):
                    out += joiner.rest() if joiner else []
                    begins = np.searchsorted(sent.value, key)
                    joiner = _Joiner(file, start, begins < len(sent.value) and sent.value[begins] == key, patterns)
                out += joiner.add(part)
            yield _table(out, names, "sibll")
        if joiner:
            yield _table(joiner.rest(), names, "sibll")

    def _ids(batch):
        file, start, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "start", "id"))
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        return ids[[0, *cuts]].tolist() if batch.num_rows else []

    from ..session import scratch_path
    where = scratch_path(spark, "csv-records")
    (lines.withColumn("id", F.xxhash64("file", "start"))
     .mapInArrow(join, "value string, kind int, first boolean, file long, start long").write.parquet(where))
    found = spark.read.parquet(where)
    # a fragment belongs to the record whose beginning came last; a split has its HEAD before its TAIL
    pieces = found.where(F.col("kind") != RECORD)
    opened = F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("start", "kind"))
    whole = (pieces.withColumn("opened", opened).groupBy("file", "opened")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("parts"), F.max("first").alias("first"))
             .select(F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"), "first"))
    every = found.where(F.col("kind") == RECORD).select("value", "first").unionByName(whole)
    return every.select(F.regexp_replace("value", "\r$", "").alias("value"), "first").where(F.trim("value") != "")


def parse(records_: DataFrame, header_line: str | None, sep: str) -> DataFrame:
    """The records as columns with inferred types, by Spark's CSV parser; ``header_line`` names
    them (the first records of the files are then left out)."""
    spark = records_.sparkSession
    reader = spark.read.options(sep=sep, quote='"', escape='"', inferSchema=True, mode="PERMISSIVE", multiLine=True)

    def read(rows: DataFrame) -> DataFrame:
        strings = getattr(rows.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(reader._jreader.csv(strings), spark)

    if header_line is None:
        return read(records_)
    names = _names(header_line, sep)
    body = read(records_.where(~F.col("first")))
    if not body.columns:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    more = [F.lit(None).cast("string").alias(n) for n in names[len(body.columns):]]
    kept = [F.col(c).alias(n) for c, n in zip(body.columns, names)]
    return body.select(*kept, *more)


def _names(line: str, sep: str) -> list[str]:
    """Column names; empty and repeated ones get their place, as Spark's reader does."""
    import csv
    fields = [f.lstrip("\ufeff") for f in next(csv.reader([line], delimiter=sep), [])]
    low = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if low.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


def read_records(spark: SparkSession, path: str, sep: str, header: bool, inside: np.ndarray | None = None) -> DataFrame:
    """The CSV files below ``path``, whatever their quoted fields hold, read split by split."""
    rows = records(spark, path, sep, inside)
    first = rows.where("first").select("value").first() if header else None
    return parse(rows, first["value"] if first else None, sep)
