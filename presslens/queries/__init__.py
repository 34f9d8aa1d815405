"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from presslens.session import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows: list[tuple]) -> str:
    """Rows as SQL; the same text runs in both engines."""
    return "VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)


def constant(spark: SparkSession, rows: list[tuple], names: str, kinds: str | None = None) -> DataFrame:
    """A small fixed relation. names: a, b, c; kinds: types of them, strings unless given."""
    cols = [n.strip() for n in names.split(",")]
    ks = [k.strip() for k in kinds.split(",")] if kinds else ["string"] * len(cols)
    return spark.sql(f"SELECT {', '.join(f'CAST({c} AS {k}) AS {c}' for c, k in zip(cols, ks, strict=True))} FROM ({values(rows)}) AS t({names})")


def named(rows: list[tuple], name: str, names: str) -> str:
    """A fixed relation as a CTE."""
    return f"{name}({names}) AS ({values(rows)})"


def _cases(rows: list[tuple]) -> int:
    return max(r[0] for r in rows) + 1


#: Rows of a task where a row is dealt cases: a small file of many rows would be one task.
TASK_ROWS = 25_000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key to as many tasks as its rows ask for."""
    n = df.count()
    return df.repartition(-(-n // TASK_ROWS), key) if n > TASK_ROWS else df


def spread(spark: SparkSession, sf_dir: str, rows: list[tuple], names: str, kinds: str, of: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Fixed cases dealt over a whole table: each row of it has the rows of case key % n, the first column of rows. {s} in a text becomes a letter that the key decides."""
    from pyspark.sql import functions as F

    t = constant(spark, rows, "case_, " + names, "int, " + kinds)
    letter = F.chr(F.lit(97) + F.col(key) % 26)
    texts = {n.strip() for n, k in zip(names.split(","), kinds.split(","), strict=True) if k.strip() == "string"}
    own = dealt(table(spark, sf_dir, of).select(key), key).select(key, (F.col(key) % _cases(rows)).cast("int").alias("case_"))
    return own.join(F.broadcast(t), "case_").select(key, *[F.replace(c, F.lit("{s}"), letter).alias(c) if c in texts else F.col(c) for c in t.columns if c != "case_"])


def spread_sql(name: str, rows: list[tuple], names: str, kinds: str, of: str = "customer", key: str = "c_custkey") -> str:
    """The same as CTEs."""
    cols = [(f'"{n.strip()}"', k.strip()) for n, k in zip(names.split(","), kinds.split(","), strict=True)]
    letter = f"chr(CAST(97 + {key} % 26 AS INTEGER))"
    out = ", ".join(f"replace(CAST({c} AS VARCHAR), '{{s}}', {letter}) AS {c}" if k == "string" else f"CAST({c} AS {k}) AS {c}" for c, k in cols)
    quoted = ", ".join(c for c, _ in cols)
    return f"{name}_cases(case_, {quoted}) AS ({values(rows)}), {name} AS (SELECT {key}, {out} FROM {of} JOIN {name}_cases ON {key} % {_cases(rows)} = case_)"
