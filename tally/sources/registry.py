"""Statement files by format name, for the DataFrame reader's users and for SQL.

Files are parsed once, when they are registered or read: the parsed rows are
written to the shared folder, and both views read them there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.sources import statements as st

#: The options of each format: name -> what it must be. The first of a tuple is the default; ``...`` marks one that must be given.
OPTIONS: dict[str, dict] = {
    "mt940": {"dialect": ("generic", "subfielded")},
    "mt942": {"dialect": ("generic", "subfielded")},
    "bai2": {},
    "camt053": {},
    "csv": {"mapping": ...},
    "text": {},
    "pdf": {"extract": ..., "profile": tuple(st.PDF_PROFILES)},
}


def checked(fmt: str, options: dict) -> dict:
    """``options`` with the defaults of the format; ValueError for what it does not know, lack or allow."""
    if fmt not in OPTIONS:
        raise ValueError(f"no statement format is named {fmt}; there are {', '.join(sorted(OPTIONS))}")
    known, out = OPTIONS[fmt], {}
    if extra := sorted(set(options) - set(known)):
        raise ValueError(f"{fmt} has no option {', '.join(extra)}")
    for name, allowed in known.items():
        value = options.get(name, allowed[0] if isinstance(allowed, tuple) else None)
        if value is None:
            raise ValueError(f"{fmt} needs the option {name}")
        if isinstance(allowed, tuple) and value not in allowed:
            raise ValueError(f"{name} of {fmt} is one of {', '.join(allowed)}, not {value}")
        out[name] = value
    return out


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files under ``path``, a folder, file or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_statements(files: DataFrame, fmt: str, **options) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, errors) of ``files`` (path, content) in the format ``fmt``; a file with an error gives errors only."""
    options = checked(fmt, options)
    return st.gate(st.PARSERS[fmt](files, **options))


def register(spark: SparkSession, view: str, source: str | DataFrame, fmt: str, **options) -> None:
    """Makes files readable by SQL: ``view`` has the accepted rows, ``view``_errors the errors (path, row, field, message)."""
    accepted, errors = read_statements(files_of(spark, source) if isinstance(source, str) else source, fmt, **options)
    accepted.createOrReplaceTempView(view)
    errors.createOrReplaceTempView(f"{view}_errors")


def sniffed(files: DataFrame, by_format: dict[str, dict] | None = None, otherwise: Callable | None = None) -> DataFrame:
    """(format, path, ...) accepted rows of files of several formats, each told by its first bytes.

    ``by_format`` are the options of the formats to read; files of no known
    format go to ``otherwise`` (files -> parsed rows) or are left out.
    """
    told = files.withColumn("format", st.detect_format(F.col("content")))
    parts = [read_statements(told.where(F.col("format") == fmt).drop("format"), fmt, **options)[0].withColumn("format", F.lit(fmt)) for fmt, options in (by_format or {}).items()]
    if otherwise is not None:
        parts.append(st.gate(otherwise(told.where("format is null").drop("format")))[0].withColumn("format", F.lit("csv")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
