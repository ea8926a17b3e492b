"""Long (id, cmd, strata, var, value) results and their pivot into wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id string, cmd string, strata map<string,string>, var string, d double, s string"


def long(df: DataFrame, cmd: str, factors: list[str], variables: list[str], id_col: str = "id") -> DataFrame:
    """Wide rows as results; factors become upper-case strata, numbers go to d and the rest to s."""
    kinds = dict(df.dtypes)
    strata = F.create_map(*(x for f in factors for x in (F.lit(f.upper()), F.col(f).cast("string")))) if factors else F.create_map().cast("map<string,string>")
    text = lambda v: kinds[v] in ("string", "boolean")
    cells = F.array(*(F.struct(F.lit(v).alias("var"), (F.lit(None) if text(v) else F.col(v)).cast("double").alias("d"), (F.col(v) if text(v) else F.lit(None)).cast("string").alias("s")) for v in variables))
    return df.select(F.col(id_col).alias("id") if id_col in df.columns else F.lit(None).alias("id"), F.lit(cmd).alias("cmd"), strata.alias("strata"), F.explode(cells).alias("c")).select("id", "cmd", "strata", "c.var", "c.d", "c.s")


def pivot(results: DataFrame, rows: list[str], cols: dict[str, list[str]], variables: list[str], value: str = "d") -> DataFrame:
    """Rows by id and row factors; columns ``VAR.FAC_LVL``, with levels given, in one aggregation."""
    keys = [F.element_at("strata", f).alias(f) for f in rows]
    out = []
    levels = [[]]
    for f, ls in cols.items():
        levels = [p + [(f, x)] for p in levels for x in ls]
    for v in variables:
        for combo in levels:
            hit = F.col("var") == v
            for f, x in combo:
                hit = hit & (F.element_at("strata", f) == x)
            out.append(F.max(F.when(hit, F.col(value))).alias(v + "".join(f".{f}_{x}" for f, x in combo)))
    return results.groupBy("id", *keys).agg(*out)


def to_sqlite(results: dict, path: str) -> None:
    """Result tables (command, factors) as tables of an SQLite file on the driver, fetched a partition at a time."""
    import sqlite3

    with sqlite3.connect(path) as db:
        for (cmd, factors), df in results.items():
            name = "_".join([cmd, *factors])
            db.execute(f'DROP TABLE IF EXISTS "{name}"')
            db.execute(f'CREATE TABLE "{name}" ({", ".join(f"""\"{c}\"""" for c in df.columns)})')
            plain = df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes))
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(df.columns))})', (tuple(r) for r in plain.toLocalIterator()))
    db.close()


def from_sqlite(spark, path: str) -> dict[str, DataFrame]:
    """Tables of an SQLite file written before, by name."""
    import sqlite3

    import pandas as pd

    db = sqlite3.connect(path)
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    out = {n: spark.createDataFrame(pd.read_sql_query(f'SELECT * FROM "{n}"', db)) for n in names if db.execute(f'SELECT count(*) FROM "{n}"').fetchone()[0]}
    db.close()
    return out


def to_text(results: dict, folder: str) -> None:
    """Result tables as folders of tab-separated text with a header."""
    for (cmd, factors), df in results.items():
        plain = df.select(*(F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(c) for c, k in df.dtypes))
        plain.write.mode("overwrite").option("header", True).csv(f"{folder}/{'_'.join([cmd, *factors])}", sep="\t")
