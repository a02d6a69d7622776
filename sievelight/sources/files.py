"""Reading delimited files, spreadsheets and databases with inferred types."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File names that are read, and bytes of a file at most (where it comes as an upload).
SUFFIXES, SHEETS, MOST_BYTES = (".csv", ".tsv", ".txt"), (".xlsx",), 200 << 20
DRIVERS = {"postgresql": 5432, "mysql": 3306}
#: Bytes that are looked at for the encoding, and characters for the delimiter.
HEAD, SNIFFED, DELIMITERS = 200_000, 100_000, ",;\t|"
ROW_ID = "_row_id"


# ---------------------------------------------------------------- bytes of any Hadoop path


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def size_of(spark: SparkSession, path: str) -> int:
    files, at = _file_system(spark, path)
    return files.getFileStatus(at).getLen()


def read_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """The first ``most`` bytes of a file of any Hadoop file system, on the driver; the rest is not read."""
    files, at = _file_system(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    files, at = _file_system(spark, path)
    stream = files.create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def check_upload(name: str, size: int, most: int = MOST_BYTES) -> None:
    """Raises ValueError for a file that isn't read: by its name, by its size, or because it is empty."""
    if not name.lower().endswith((*SUFFIXES, *SHEETS)):
        raise ValueError(f"not a file of a known kind: {name}")
    if size > most:
        raise ValueError(f"the file is larger than {most >> 20} MB")
    if size == 0:
        raise ValueError("the file is empty")


# ---------------------------------------------------------------- delimited files


def encoding_of(head: bytes) -> str:
    """UTF-8 where the bytes are (a character cut at the end aside), else what they look most like."""
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "UTF-16"
    try:
        head.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 3 and len(head) > 3:
            return "UTF-8"
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(head).best()
    except ImportError:
        best = None
    # two-byte encodings of ASCII-heavy text are never a better guess than western European
    return best.encoding if best is not None and best.encoding.startswith(("cp125", "latin", "iso8859", "koi8", "gb", "big5", "shift", "euc")) else "windows-1252"


def sniff(head: bytes) -> tuple[str, str]:
    """Encoding and delimiter of a file, from its first bytes."""
    encoding = encoding_of(head)
    try:
        return encoding, csv.Sniffer().sniff(head.decode(encoding, "replace")[:SNIFFED], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return encoding, ","


def numbered(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """``df`` with the place of each row, from 0 without gaps: rows of a partition are counted, then numbered; nothing is shuffled but the counts."""
    parts = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    offsets = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    # the ids of a partition count up from its number times 2 ** 33
    own = parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))
    return own.select(name, *df.columns)


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False, row_id: bool = False) -> DataFrame:
    """A delimited file with its types inferred; an error where no row holds a value.

    Only the head is read to find encoding and delimiter. Files are split over
    tasks unless ``multi_line`` says that quoted values span lines.
    """
    encoding, sep = sniff(read_bytes(spark, path, HEAD))
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=multi_line, escape='"')
    return _loaded(df.toDF(*[c.strip() for c in df.columns]), row_id)


def _loaded(df: DataFrame, row_id: bool) -> DataFrame:
    if df.dropna("all").isEmpty():
        raise ValueError("the file holds no rows")
    return numbered(coerce(df)) if row_id else coerce(df)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """The cells of a workbook's first sheet as text (a sheet has about a million rows at most)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))
        shared = [text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        rows = []
        for row in ElementTree.fromstring(book.read(first)).iter(f"{_SHEET}row"):
            cells: list[str | None] = []
            for cell in row.iter(f"{_SHEET}c"):
                at = 0
                for c in cell.get("r", ""):
                    at = at * 26 + ord(c) - 64 if c.isalpha() else at
                at = at or len(cells) + 1
                cells += [None] * (at - len(cells))
                value = cell.find(f"{_SHEET}v")
                kind = cell.get("t")
                cells[at - 1] = text(cell) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            rows.append(cells)
    return rows


def read_sheet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """The first sheet of an XLSX file, its first row as names, types inferred."""
    rows = sheet_rows(read_bytes(spark, path, MOST_BYTES))
    if len(rows) < 2:
        raise ValueError("the file holds no rows")
    names = [(n or f"column_{i}").strip() for i, n in enumerate(rows[0])]
    body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    schema = ", ".join(f"`{n}` string" for n in names)
    return _loaded(spark.createDataFrame(body, schema).coalesce(1), row_id)


def read_dataset(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A file by its name: a sheet, or delimited text; with ``_row_id``."""
    check_upload(path, size_of(spark, path), 1 << 62 if path.lower().endswith(SUFFIXES) else MOST_BYTES)
    return read_sheet(spark, path, True) if path.lower().endswith(SHEETS) else read_delimited(spark, path, multi_line, True)


def coerce(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a number become long or double; a leading zero keeps a column text."""
    texts = [c for c, t in df.dtypes if t == "string"]
    v = {c: F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "") for c in texts}
    tests = []
    for i, c in enumerate(texts):
        number = v[c].rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        tests += [F.bool_and(number & ~v[c].rlike("^0[0-9]")).alias(f"n{i}"), (F.bool_and(v[c].rlike("^[+-]?[0-9]{1,18}$")) & (F.count(v[c]) == F.count(F.lit(1)))).alias(f"w{i}")]
    if not texts:
        return df
    found = df.agg(*tests).first()
    return df.select(*[v[c].cast("long" if found[f"w{texts.index(c)}"] else "double").alias(c) if c in v and found[f"n{texts.index(c)}"] else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------- databases


def jdbc_url(kind: str, host: str, port: int | None, database: str) -> str:
    if kind not in DRIVERS:
        raise ValueError(f"unknown database: {kind}")
    return f"jdbc:{kind}://{host}:{port or DRIVERS[kind]}/{database}"


def test_connection(spark: SparkSession, url: str, probe: str = "SELECT 1 AS ok", **options: str) -> None:
    """Raises where the database can't be reached or asked."""
    spark.read.format("jdbc").option("url", url).option("query", probe).options(**options).load().first()


test_connection.__test__ = False


def read_database(spark: SparkSession, url: str, query: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """The rows of a query; an error where it gives none.

    ``split`` (column, lower, upper, parts) reads the ranges of a numeric
    column in as many tasks.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split:
        names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
        df = reader.option("dbtable", f"({query}) q").options(**{k: str(v) for k, v in zip(names, split, strict=True)}).load()
    else:
        df = reader.option("query", query).load()
    if df.isEmpty():
        raise ValueError("the query returned no rows")
    return df


def refresh(spark: SparkSession, url: str, query: str, path: str, **options) -> DataFrame:
    """Asks the database again and replaces the snapshot at ``path`` by what it says."""
    read_database(spark, url, query, **options).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
