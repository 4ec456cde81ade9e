"""Registration of queries under their functions' names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans import canonical as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _plain(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, which both engines write alike."""
    money = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return frame.withColumns({c: F.col(c).cast("double") for c in money}) if money else frame


def query(sql: str | None = None, ledgers: bool = False, cases: bool = False, money: tuple[str, ...] = ()):
    """Register a query under its function's name, with SQL over the ledgers or cases where asked for.

    ``money`` names the SQL's decimal columns.
    """

    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: _plain(function(spark, sf_dir))
        if sql is not None:
            parts = [C.SOURCE_SQL, C.TARGET_SQL] * ledgers + [C.CASES_SQL] * cases
            body = sql.strip()
            word = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
            if parts:
                body = (word or "WITH ") + ", ".join(parts) + (", " + body[len(word) :] if word else " " + body)
            if money:
                body = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in money)}) FROM ({body})"
            SQL[name] = body
        return function

    return add
