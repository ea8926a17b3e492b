"""Long and wide tables: vertical views, factors to columns, partial rows, extraction, dictionaries, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: cells that count as missing
MISSING = ("NA", ".", "")


def present(c: str) -> Column:
    """The cell as text, null if it is missing."""
    t = F.col(c).cast("string")
    return F.when(~t.isin(*MISSING), t)


def vertical(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, variable, value): a row for each cell; ``pos`` counts the other columns from 1."""
    names = [c for c in df.columns if c not in keys]
    cells = F.array(*(F.struct(F.lit(k + 1).alias("pos"), F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for k, c in enumerate(names)))
    return df.select(*keys, F.inline(cells))


def by_columns(df: DataFrame, rows: list[str], cols: dict[str, list]) -> DataFrame:
    """A row for each level of ``rows``; every other column X becomes X.F_l... for the listed levels of ``cols``.

    The levels are given, so it is one aggregation. Several values in a cell: the largest.
    """
    combos: list[list[tuple[str, object]]] = [[]]
    for f, levels in cols.items():
        combos = [c + [(f, x)] for c in combos for x in levels]
    out = []
    for v in (c for c in df.columns if c not in rows and c not in cols):
        for combo in combos:
            hit = F.lit(True)
            for f, x in combo:
                hit = hit & (F.col(f) == F.lit(x))
            out.append(F.max(F.when(hit, F.col(v))).alias(v + "".join(f".{f}_{x}" for f, x in combo)))
    return df.groupBy(*rows).agg(*out)


def filled_rows(df: DataFrame, keys: list[str], keep_empty: bool = False) -> DataFrame:
    """One row for each key: of each column the value that is not missing, as text.

    Two different values in a cell are an error. Rows without any value go, unless
    ``keep_empty``.
    """
    names = [c for c in df.columns if c not in keys]
    text = df.select(*keys, *(present(c).alias(c) for c in names))
    d = text.groupBy(*keys).agg(*(F.min(c).alias(c) for c in names), *(F.max(c).alias(f"_{k}") for k, c in enumerate(names)))
    checked = [F.when(F.col(c) != F.col(f"_{k}"), F.raise_error(F.concat(F.lit(f"different values of {c}: "), F.col(c), F.lit(", "), F.col(f"_{k}")))).otherwise(F.col(c)).alias(c) for k, c in enumerate(names)]
    d = d.select(*keys, *checked)
    return d if keep_empty or not names else d.where(F.coalesce(*(F.col(c) for c in names)).isNotNull())


def extracted(results: DataFrame, ids: list[str] | None = None, variables: list[str] | None = None, commands: list[str] | None = None, levels: dict[str, list[str]] | None = None, without: dict[str, list[str]] | None = None) -> DataFrame:
    """Long results (id, cmd, strata, var, ...) of the ids, variables, commands and levels listed, less those of ``without``."""
    d = results
    for col, want in (("id", ids), ("var", variables), ("cmd", commands)):
        d = d.where(F.col(col).isin(want)) if want else d
    for f, want in (levels or {}).items():
        d = d.where(F.element_at("strata", f).isin(want))
    for f, bad in (without or {}).items():
        d = d.where(~F.coalesce(F.element_at("strata", f).isin(bad), F.lit(False)))
    return d


def typed(df: DataFrame, keys: list[str], dictionary: list[tuple[str, str, list[str]]]) -> DataFrame:
    """The columns that a data dictionary (name, kind, missing codes) has, as numbers (``num``), whole numbers (``int``) or text; codes become null.

    Names match without case and take the dictionary's spelling; columns it lacks go.
    """
    kinds = {"num": "double", "int": "long", "text": "string"}
    own = {c.upper(): c for c in df.columns}
    out = []
    for name, kind, codes in dictionary:
        if name.upper() in own:
            t = F.col(own[name.upper()]).cast("string")
            out.append(F.when(~t.isin(*MISSING, *codes), t.try_cast(kinds[kind])).alias(name))
    return df.select(*keys, *out)


def joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Study tables side by side: a full join by key; a column that two tables have is an error."""
    out = parts[0]
    for p in parts[1:]:
        if clash := (set(out.columns) & set(p.columns)) - set(keys):
            raise ValueError(f"columns in two tables: {sorted(clash)}")
        out = out.join(p, keys, "full")
    return out


def mapped_labels(df: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``label``: the name of the first rule (pattern, name) that fits the whole of ``col`` without case, blanks and punctuation as _; null if none does."""
    plain = F.regexp_replace(F.upper(F.trim(col)), "[^A-Z0-9]+", "_")
    hit = F.coalesce(*(F.when(plain.rlike(f"^(?:{p.upper()})$"), F.lit(name)) for p, name in rules), F.lit(None).cast("string"))
    return df.withColumn("label", hit)


def picked(df: DataFrame, by: list[str], n: int, seed: int = 1) -> DataFrame:
    """Exactly min(n, size) rows of each group, those of smallest hash of the row: the same for any partitioning.

    A group's candidates are cut in buckets of the hash first, so that a hot group
    isn't ordered in one task.
    """
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), *(F.col(c) for c in df.columns))
    d = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(64))})
    first = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h"))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= n).drop("_h", "_b", "_r")
