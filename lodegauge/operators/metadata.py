"""Metadata sheets of tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names of column types as data-frame libraries give them (fixed values).
CSV_TYPES = {"bigint": "int64", "int": "int64", "double": "float64", "float": "float64", "boolean": "bool"}
JSON_TYPES = {"bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "bool", "string": "str"}


def table_metadata(df: DataFrame, name: str) -> dict:
    """Rows, columns and column types of a table, as for a CSV file. A column of whole numbers with nulls is float64."""
    from pyspark.sql import functions as F

    counts = df.agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kind = lambda i, t: "float64" if t in ("bigint", "int") and counts[f"c{i}"] < counts["n"] else CSV_TYPES.get(t, "object")
    columns = [{"name": c, "type": kind(i, t)} for i, (c, t) in enumerate(df.dtypes)]
    return _sheet(name) | {"number_of_rows": counts["n"], "number_of_columns": len(columns), "columns": columns} | _tail()


def json_metadata(df: DataFrame, name: str) -> dict:
    """Records and fields of an array of objects; types are those of the first record."""
    if df.columns == ["_corrupt_record"] or not isinstance(df.schema, T.StructType):
        raise ValueError("expected an array of objects")
    first = df.first()
    kind = lambda c, t: "NoneType" if first[c] is None else "list" if t.startswith("array") else "dict" if t.startswith(("struct", "map")) else JSON_TYPES.get(t, "str")
    columns = [{"name": c, "type": kind(c, t), "description": f"Description of {c}"} for c, t in df.dtypes] if first else []
    return _sheet(name) | {"number_of_records": df.count(), "columns": columns} | _tail()


def _sheet(name: str) -> dict:
    return {"file_name": name, "creation_date": date.today().isoformat(), "source": "Specify the data source"}


def _tail() -> dict:
    return {"preprocessing": [], "notes": "Add any additional notes here"}
