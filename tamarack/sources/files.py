"""Reading and writing CSV, SQL scripts and SQLite files."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def import_csv(spark: SparkSession, path: str, header: bool = True, null_value: str = "", delimiter: str = ",", types: dict[str, str] | None = None, ignore_errors: bool = False) -> DataFrame:
    """CSV with types found over all rows: integer, else real, else text."""
    raw = spark.read.csv(path, header=header, sep=delimiter, nullValue=null_value, mode="DROPMALFORMED" if ignore_errors else "PERMISSIVE")
    if not raw.columns:
        return raw
    sure = types or {}
    ask = [c for c in raw.columns if c not in sure]
    fits = lambda c, kind: F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(kind).isNotNull())
    whole = lambda c: F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").rlike(r"^[+-]?\d+$"))
    found = raw.agg(*[x for i, c in enumerate(ask) for x in ((whole(c) & fits(c, "bigint")).alias(f"i{i}"), fits(c, "double").alias(f"r{i}"))]).head() if ask else None
    kinds = dict(sure) | {c: "bigint" if found[f"i{i}"] else "double" if found[f"r{i}"] else "string" for i, c in enumerate(ask)}
    return raw.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in raw.columns])


def csv_text(x: Column, kind: str, null_value: str = "") -> Column:
    """A value as the CSV export writes it: whole reals without .0, truth as 1 and 0, bytes as 0x..."""
    if kind == "boolean":
        text = F.when(x, "1").otherwise("0")
    elif kind in ("float", "double"):
        text = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))
    elif kind == "binary":
        text = F.concat(F.lit("0x"), F.lower(F.hex(x)))
    else:
        text = x.cast("string")
    return F.when(x.isNull(), F.lit(null_value)).otherwise(text)


def export_csv(df: DataFrame, path: str, header: bool = True, null_value: str = "", delimiter: str = ",") -> None:
    df.select(*[csv_text(F.col(f"`{c}`"), k, null_value).alias(c) for c, k in df.dtypes]).write.csv(path, header=header, sep=delimiter, emptyValue="")


def split_statements(script: str) -> list[str]:
    """Statements of a script; semicolons in quotes and comments don't end one."""
    out, begin, i, n = [], 0, 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            i = script.find(c, i + 1)
            i = n if i < 0 else i + 1
        elif script.startswith("--", i):
            i = script.find("\n", i)
            i = n if i < 0 else i
        elif script.startswith("/*", i):
            i = script.find("*/", i)
            i = n if i < 0 else i + 2
        else:
            if c == ";":
                out.append(script[begin:i])
                begin = i + 1
            i += 1
    out.append(script[begin:])
    bare = re.compile(r"(?:\s|--[^\n]*|/\*[\s\S]*?\*/)*")
    return [s.strip() for s in out if not bare.fullmatch(s)]


def run_script(spark: SparkSession, script: str, ignore_errors: bool = False) -> int:
    """Runs each statement; returns how many ran."""
    done = 0
    for statement in split_statements(script):
        try:
            spark.sql(statement)
            done += 1
        except Exception:
            if not ignore_errors:
                raise
    return done


def literal(x: Column, kind: str) -> Column:
    """A value as an SQL literal."""
    if kind in ("string", "timestamp_ntz", "timestamp", "date"):
        text = F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        text = F.concat(F.lit("x'"), F.hex(x), F.lit("'"))
    elif kind == "boolean":
        text = F.when(x, "1").otherwise("0")
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def dump_sql(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The CREATE TABLE statement, and the INSERT statements as a table of one column."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "float": "REAL", "double": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    create = f"CREATE TABLE {name} (" + ", ".join(f"{c} {kinds.get(k, 'TEXT')}" for c, k in df.dtypes) + ");"
    values = F.concat_ws(", ", *[literal(F.col(f"`{c}`"), k) for c, k in df.dtypes])
    return create, df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", "8"))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            yield from c.execute(f'SELECT * FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name); ranges of rowids
    are read by separate tasks."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            columns = c.execute(f"PRAGMA table_info(\"{self.options['table']}\")").fetchall()
        return ", ".join(f"`{name}` {affinity(kind)}" for _, name, kind, *_ in columns)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


def affinity(declared: str) -> str:
    """The type for a declared type name, by its letters."""
    d = (declared or "").upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "UUID", "JSON", "DATE", "TIME")):
        return "string"
    if "BLOB" in d or not d:
        return "binary"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "boolean" if "BOOL" in d else "double"


def import_sqlite(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    return {n: spark.read.format("sqlite").option("path", path).option("table", n).load() for n in names}
