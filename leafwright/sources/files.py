"""Sources and sinks: JSON lines, CSV in several encodings, ordered CSV, resumable append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENCODINGS = ("UTF-8", "ISO-8859-1")


def _windows_signs() -> tuple[str, str]:
    """What ISO-8859-1 reads as control characters, and the signs that these bytes are in windows-1252; five bytes are no sign there."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(c for c, sign in pairs if sign), "".join(sign for _, sign in pairs)


_CONTROLS, _SIGNS = _windows_signs()


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped. Strict: a broken line fails the job; else its columns are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """All columns as strings; the first encoding in which no row shows a replacement sign; a byte-order mark goes."""
    for encoding in encodings:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
        broken = F.exists(F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns)), lambda x: x.contains("�"))
        if encoding == encodings[-1] or ("�" not in "".join(df.columns) and df.where(broken).isEmpty()):
            # Texts in one byte a sign are windows-1252 as a rule; Spark reads only what both encodings share.
            signs = str.maketrans(_CONTROLS, _SIGNS)
            return df if encoding != "ISO-8859-1" else df.select(*(F.translate(F.col(f"`{c}`"), _CONTROLS, _SIGNS).alias(c.translate(signs)) for c in df.columns))
    raise ValueError("no encoding given")


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json") -> DataFrame:
    """An empty table of the schema where the path does not exist."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def discovered(spark: SparkSession, candidates: tuple[str, ...], pattern: str | None = None) -> str:
    """The first candidate that exists, else the last match of the pattern by name; none is an error that names them."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    for path in candidates:
        place = fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return path
    if pattern is not None:
        place = fs.Path(pattern)
        found = place.getFileSystem(conf).globStatus(place) or []
        if len(found):
            return max(str(f.getPath()) for f in found)
    raise FileNotFoundError(f"none of {', '.join(candidates)}" + (f", nor {pattern}" if pattern else ""))


def fullest(spark: SparkSession, paths: list[str], schema: T.StructType | str, clauses: str = "clauses") -> str:
    """Of files of rows with an array of clauses the one with most clauses; the first of equals."""
    counts = [(read_jsonl(spark, p, schema, strict=False).agg(F.coalesce(F.sum(F.greatest(F.size(clauses), F.lit(0))), F.lit(0))).first()[0], -k) for k, p in enumerate(paths)]
    return paths[-max(counts)[1]]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; nulls stay as keys."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A summary of one row as one JSON file; more rows are an error."""
    if df.limit(2).count() > 1:
        raise ValueError("a summary is one row")
    df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).coalesce(1).write.mode(mode).text(path)


def cell(name: str, kind: T.DataType) -> Column:
    """A CSV cell: null as nothing, booleans as 1 and 0, nested values as JSON."""
    column = F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        column = column.cast("int")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        column = F.to_json(column)
    return F.coalesce(column.cast("string"), F.lit("")).alias(name)


def write_csv(df: DataFrame, path: str, first: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """CSV with the named columns first; refuses to overwrite unless told otherwise."""
    order = [c for c in first if c in df.columns] + [c for c in df.columns if c not in first]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df.select(*(cell(c, kinds[c]) for c in order)).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def append_missing(df: DataFrame, path: str, key: str, done: str = "status = 'ok'") -> int:
    """Appends rows whose key is not done in the JSON-lines sink; returns how many."""
    before = read_optional(df.sparkSession, path, df.schema).where(done).select(key).distinct()
    # Rows may be paid for, so they are computed once: counted while they are written.
    seen = Observation("new")
    df.join(before, key, "left_anti").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]
