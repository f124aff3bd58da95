"""Registration of queries with the SQL that they are compared with, and small fixed relations."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """The queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Relation:
    """Small fixed rows in words that the tables do not hold, the same for Spark and for SQL.

    ``tables``: a query in the SQL of both, its tables in braces, for the rows that a whole table adds to them.
    """

    def __init__(self, name: str, schema: str, rows: list[tuple], tables: str | None = None):
        self.name, self.schema, self.rows, self.tables = name, schema, rows, tables

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        """The fixed rows, and those of the tables if a folder is given."""
        fixed = spark.createDataFrame(self.rows, self.schema)
        if sf_dir is None or self.tables is None:
            return fixed
        used = {name: table(spark, sf_dir, name) for name in re.findall(r"{(\w+)}", self.tables)}
        # the other SQL's concat leaves nulls out, as concat_ws does here
        return fixed.unionByName(spark.sql(re.sub(r"\bconcat\(", "concat_ws('', ", self.tables), **used))

    def whole(self) -> str:
        """As ``cte``, with the rows of the tables."""
        more = re.sub(r"{(\w+)}", r"\1", self.tables).replace(r"explode(split(text, '\n'))", "unnest(string_split(text, chr(10)))").replace("array(", "list_value(")
        return self.cte().removesuffix(")") + f" UNION ALL {more})"

    def cte(self) -> str:
        """``name(columns) AS (VALUES ...)`` for a WITH clause."""
        columns = [c.strip().split(" ")[0] for c in _split(self.schema)]
        kinds = [_KINDS.get(c.strip().split(" ", 1)[1].strip().lower(), "VARCHAR") for c in _split(self.schema)]
        values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in self.rows)
        cast = ", ".join(f"CAST({c} AS {k}) AS {c}" for c, k in zip(columns, kinds))
        return f"{self.name} AS (SELECT {cast} FROM (VALUES {values}) AS v({', '.join(columns)}))"


_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]"}


def _split(schema: str) -> list[str]:
    return [p for p in schema.split(",") if p.strip()]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    text = "'" + str(v).replace("'", "''") + "'"
    return text.replace("\n", "' || chr(10) || '") if "\n" in text else text


def quoted(values) -> str:
    """A SQL list of string literals."""
    return "[" + ", ".join(_literal(v) for v in values) + "]"


def sql_case(lexicon: dict[str, list[str]], column: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(words, column)} THEN '{tag}'" for tag, words in lexicon.items()) + f" ELSE '{default}' END"


def sql_any(words, column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {_literal(w)})" for w in words) + ")"


def sql_tags(lexicon: dict[str, list[str]], column: str) -> str:
    items = ", ".join(f"CASE WHEN {sql_any(words, column)} THEN '{tag}' END" for tag, words in sorted(lexicon.items()))
    return f"list_filter([{items}], lambda t: t IS NOT NULL)"
