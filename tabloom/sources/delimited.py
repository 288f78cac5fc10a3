"""Delimited text files: missing-value tokens, type inference, encodings, and rows that span lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.ranking import dense_index
from tabloom.sources.records import read_records

# Texts read as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
_PLACE = ("_file", "_block", "_line")
_UTF8_NAMES = {"utf-8", "utf8", "utf-8-sig"}
_CP1252_NAMES = {"cp1252", "windows-1252"}
_LATIN_NAMES = {"latin1", "latin-1", "iso-8859-1"}


def _cp1252_pairs() -> tuple[str, str]:
    """The bytes 0x80-0x9F as Latin-1 reads them, and the characters cp1252 gives them."""
    latin, windows = [], []
    for byte in range(0x80, 0xA0):
        try:
            windows.append(bytes([byte]).decode("cp1252"))
            latin.append(chr(byte))
        except UnicodeDecodeError:
            continue
    return "".join(latin), "".join(windows)


def latin_to_cp1252(text: Column) -> Column:
    """Reinterpret text that was decoded as Latin-1 as cp1252."""
    return F.translate(text, *_cp1252_pairs())


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: is it valid UTF-8, does cp1252 reject it, may a quoted field span lines.

    ``bare_returns`` marks quoted files in which a carriage return stands without a line feed. Lines are judged in
    parallel and combined per file; no file is read whole.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"))
    undefined = [b for b in range(0x80, 0xA0) if chr(b) not in _cp1252_pairs()[0]]
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    rejects = latin.rlike("[" + "".join(rf"\x{{{b:x}}}" for b in undefined) + "]")
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    return lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(rejects).alias("not_cp1252"),
        F.bool_or(quotes % 2 == 1).alias("odd_quotes"),
        (F.bool_or(F.col("value").rlike("\r[^\r]")) & (F.sum(quotes) > 0)).alias("bare_returns"),
    ).select("file", "utf8", "not_cp1252", (F.col("odd_quotes") | F.col("bare_returns")).alias("spans_lines"), "bare_returns")


def choose_encoding(utf8: bool, not_cp1252: bool, encodings: Sequence[str]) -> str:
    """The first encoding of the list that can read the file."""
    for name in encodings:
        lower = name.lower()
        if lower in _UTF8_NAMES and utf8:
            return "utf-8"
        if lower in _CP1252_NAMES and not not_cp1252:
            return "cp1252"
        if lower in _LATIN_NAMES:
            return "iso-8859-1"
        if lower not in _UTF8_NAMES | _CP1252_NAMES | _LATIN_NAMES:
            raise ValueError(f"Unsupported encoding '{name}'.")
    raise ValueError(f"None of the encodings {list(encodings)} can read the file.")


#: How the records of a file are found: by lines, by lines and the quotes before them, or by reading it whole.
_PLAIN, _BLOCKS, _WHOLE = range(3)


def _read_group(
    spark: SparkSession, files: list[str], encoding: str, way: int, sep: str, header: bool,
    names: Sequence[str] | None, keep_place: bool,
) -> DataFrame:
    options = dict(sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = spark.read.csv(
        files, header=header, inferSchema=False, multiLine=way != _PLAIN,
        encoding="UTF-8" if encoding == "utf-8" else "ISO-8859-1", **options,
    )
    columns = df.columns
    if way == _BLOCKS:
        df = _parsed(read_records(spark, files, sep, encoding != "utf-8"), len(columns), header, options, keep_place)
    elif keep_place:
        df = df.select(
            *[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias(_PLACE[0]),
            F.col("_metadata.file_block_start").alias(_PLACE[1]), F.monotonically_increasing_id().alias(_PLACE[2]),
        )
    df = df.toDF(*(names or [c.lstrip("\ufeff") for c in columns]), *(_PLACE if keep_place else ()))
    values = df.columns[: len(columns)]
    if encoding == "cp1252":
        df = df.withColumns({c: latin_to_cp1252(F.col(c)) for c in values})
    first = values[0]
    return df.withColumn(first, F.regexp_replace(first, "^\ufeff", ""))


def _parsed(records: DataFrame, width: int, header: bool, options: dict, keep_place: bool) -> DataFrame:
    """The fields of whole records; the first record of every file is its header if there is one."""
    if header:
        heads = records.groupBy("file").agg(F.min(F.struct("block", "line")).alias("head"))
        records = records.join(heads, "file").where(F.struct("block", "line") > F.col("head"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    fields = F.from_csv("record", schema.simpleString()[len("struct<"):-1].replace(":", " "), {
        **{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}, "multiLine": "true",
    })
    rows = records.select(fields.alias("f"), F.col("file").alias(_PLACE[0]), F.col("block").alias(_PLACE[1]), F.col("line").alias(_PLACE[2]))
    return rows.select("f.*", *(_PLACE if keep_place else ()))


def _groups(rows, encodings: Sequence[str]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    grouped: dict[tuple[str, int], list[str]] = {}
    for r in rows:
        way = _WHOLE if r["bare_returns"] else _BLOCKS if r["spans_lines"] else _PLAIN
        grouped.setdefault((choose_encoding(r["utf8"], r["not_cp1252"], encodings), way), []).append(r["file"])
    yield from sorted(grouped.items())


def read_strings(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: Sequence[str] | None = None,
    encodings: Sequence[str] = ("utf-8",), keep_place: bool = False,
) -> DataFrame:
    """All columns as text with missing tokens as NULL; each file in the first encoding that reads it.

    Files stay splittable also where quoted fields span lines (``sources.records``); only quoted files with
    carriage returns that no line feed follows are read unsplit. ``keep_place`` adds file, block and line columns that
    sort rows as they stand in the files.
    """
    files = scan_files(spark, path).collect()
    if not files:
        raise ValueError(f"No data in '{path}'.")
    frames = [
        _read_group(spark, paths, encoding, way, sep, header and names is None, names, keep_place)
        for (encoding, way), paths in _groups(files, encodings)
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.withColumns({c: F.when(~F.col(c).isin(list(MISSING)), F.col(c)) for c in out.columns if c not in _PLACE})


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def infer_types(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Cast text columns to bigint, double or boolean where every value allows it.

    An integer column with gaps becomes double, and so counts as numeric whatever its cardinality.
    """
    checks = []
    columns = [c for c in df.columns if c not in skip]
    for c in columns:
        whole = F.col(c).rlike(_INTEGER) & F.col(c).try_cast("bigint").isNotNull()
        checks += [
            F.count(c).alias(f"n_{c}"), F.count("*").alias(f"all_{c}"),
            F.count_if(whole).alias(f"i_{c}"), F.count_if(F.col(c).rlike(_NUMBER)).alias(f"d_{c}"),
            F.count_if(F.col(c).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b_{c}"),
        ]
    seen = df.agg(*checks).first()
    out = {}
    for c in columns:
        n = seen[f"n_{c}"]
        full = n == seen[f"all_{c}"]
        if n == seen[f"i_{c}"] and full and n:
            out[c] = F.col(c).cast("bigint")
        elif n == seen[f"d_{c}"]:
            out[c] = F.trim(F.col(c)).cast("double")
        elif n == seen[f"b_{c}"] and full:
            out[c] = F.col(c).cast("boolean")
        else:
            out[c] = F.col(c)
    return df.withColumns(out)


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: Sequence[str] | None = None,
    encodings: Sequence[str] = ("utf-8",), schema: T.StructType | str | None = None, row_id: str | None = None,
) -> DataFrame:
    """Delimited files with names from the header or from ``names`` and types from ``schema`` or the values.

    ``row_id`` names a column for the dense row number in file order.
    """
    strings = read_strings(spark, path, sep, header, names, encodings, keep_place=row_id is not None)
    place = list(_PLACE) if row_id else []
    if schema is None:
        typed = infer_types(strings, skip=place)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        typed = strings.select(*[F.col(f.name).cast(f.dataType) for f in wanted], *place)
    if row_id:
        typed = dense_index(typed, place, name=row_id).drop(*place)
    return typed
