"""Whole-project procedures: binding recordings, association matrices, permutation tests, sequences, window views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.operators import intervals as iv

NS = 1_000_000_000


def merge(parts: list[DataFrame]) -> DataFrame:
    """Row-binds sample tables of recordings with the same channels: traces are joined end to end by part."""
    d = None
    for k, p in enumerate(parts):
        p = p.withColumn("_k", F.lit(k))
        d = p if d is None else d.unionByName(p)
    v = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]))
    return d.groupBy("id", "ch", "sr", "unit").agg(v.alias("v"))


def bind(a: DataFrame, b: DataFrame) -> DataFrame:
    """Column-binds: channels of both; those of ``b`` that ``a`` has too are left out."""
    return a.unionByName(b.join(a.select("id", "ch"), ["id", "ch"], "left_anti").select(*a.columns))


def association(wide: DataFrame, xs: list[str], y: str, reps: int = 200, seed: int = 1) -> DataFrame:
    """Per variable: slope, t, p and permutation p on ``y``, with FDR-adjusted p.

    Variables are long groups, so each is one task's work whatever their number.
    """
    long = wide.select(F.col(y).cast("double").alias("_y"), F.explode(F.array(*(F.struct(F.lit(x).alias("var"), F.col(x).cast("double").alias("x")) for x in xs))).alias("c")).select("_y", "c.var", "c.x").na.drop()

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x, t = p["x"].to_numpy(), p["_y"].to_numpy()
        if len(x) < 4 or x.std() == 0:
            return pd.DataFrame([(p["var"].iloc[0], len(x), None, None, None)], columns=["var", "n", "b", "t", "emp"])
        b, tv, _ = dsp.ols(np.column_stack([x, np.ones(len(x))]), t)
        return pd.DataFrame([(p["var"].iloc[0], len(x), float(b[0]), float(tv[0]), dsp.permutation_pvalue(x, t, reps, seed))], columns=["var", "n", "b", "t", "emp"])

    r = long.groupBy("var").applyInPandas(one, "var string, n long, b double, t double, emp double")
    w = Window.orderBy("emp")  # a row per variable
    m = F.count("*").over(Window.partitionBy())
    raw = r.withColumn("_q", F.col("emp") * m / F.row_number().over(w))
    return raw.withColumn("fdr", F.least(F.lit(1.0), F.min("_q").over(Window.orderBy(F.desc("emp")).rowsBetween(Window.unboundedPreceding, 0)))).drop("_q")


def cluster_permutation(stats: DataFrame, th: float, reps: int = 200, seed: int = 1) -> DataFrame:
    """Cluster permutation test of (unit, pos, y, x): clusters of neighbouring positions with |t| > th, p by the largest null cluster.

    The positions of one test are a matrix of units by positions: bounded by the
    number of units, not by the recordings' samples.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot_table(index="unit", columns="pos", values="x").dropna()
        y = p.drop_duplicates("unit").set_index("unit")["y"].reindex(m.index).to_numpy()
        x, r = m.to_numpy(), np.random.default_rng(seed)

        def tvals(v):
            c = np.array([np.corrcoef(x[:, j], v)[0, 1] for j in range(x.shape[1])])
            return c * np.sqrt((len(v) - 2) / np.maximum(1 - c * c, 1e-12))

        def found(t):
            return [(a, b, float(np.abs(t[a:b]).sum())) for a, b in dsp.runs(np.abs(t) > th)]

        null = np.array([max((s for *_, s in found(tvals(r.permutation(y)))), default=0.0) for _ in range(reps)])
        pos = list(m.columns)
        rows = [(k + 1, float(pos[a]), float(pos[b - 1]), b - a, s, float((1 + (null >= s).sum()) / (reps + 1))) for k, (a, b, s) in enumerate(found(tvals(y)))]
        return pd.DataFrame(rows, columns=["k", "first", "last", "n", "stat", "p"])

    return stats.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda p: one(p), "k long, first double, last double, n long, stat double, p double")


def kmers(sequences: DataFrame, k: int = 3) -> DataFrame:
    """Counts of k-mers of state strings (id, seq), with expectations from state frequencies."""
    s = sequences.where(F.length("seq") >= k)
    mers = s.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("seq") - k + 1), lambda i: F.col("seq").substr(i, F.lit(k)))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("obs"))
    return mers.withColumn("freq", F.col("obs") / F.sum("obs").over(Window.partitionBy()))


def window_view(samples: DataFrame, a_s: float, b_s: float, buckets: int = 1000) -> DataFrame:
    """Traces of [a, b) seconds for display: raw where they fit, else the minimum and maximum of each bucket."""
    lo, n = F.floor(F.col("sr") * a_s), F.floor(F.col("sr") * (b_s - a_s))
    v = F.slice("v", (lo + 1).cast("int"), n.cast("int"))
    x = samples.select("id", "ch", "sr", v.alias("w")).select("id", "ch", "sr", F.size("w").alias("n"), F.posexplode("w").alias("k", "x"))
    per = F.greatest(F.lit(1), F.ceil(F.col("n") / buckets))
    g = x.groupBy("id", "ch", F.floor(F.col("k") / per).alias("bucket")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.min("k") / F.first("sr") + a_s).alias("t"))
    return g


def edited(annots: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies a queue of edits (id, class, start_ns, op, a, b): delete, shift (a), resize (a, b), rename (text in c)."""
    key = ["id", "class", "start_ns"]
    j = annots.join(edits, key, "left")
    j = j.where("op is null or op != 'delete'")
    start = F.when(F.col("op") == "shift", F.col("start_ns") + F.col("a")).when(F.col("op") == "resize", F.col("a")).otherwise(F.col("start_ns"))
    stop = F.when(F.col("op") == "shift", F.col("stop_ns") + F.col("a")).when(F.col("op") == "resize", F.col("b")).otherwise(F.col("stop_ns"))
    name = F.when(F.col("op") == "rename", F.col("c")).otherwise(F.col("class"))
    return j.withColumns({"_s": start, "_e": stop, "_n": name}).withColumns({"start_ns": F.col("_s"), "stop_ns": F.col("_e"), "class": F.col("_n")}).select(*annots.columns)


def listed_overlap(a: DataFrame, b: DataFrame, ratio: float = 0.5, width_ns: int = iv.HOUR) -> DataFrame:
    """Interval-list overlap tool: pairs whose intersection is at least ``ratio`` of their union."""
    y = b.select("id", F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    j = iv.range_join(a.select("id", "start_ns", "stop_ns"), y, ["id"], width_ns)
    inter, union = F.least("stop_ns", "r_stop") - F.greatest("start_ns", "r_start"), F.greatest("stop_ns", "r_stop") - F.least("start_ns", "r_start")
    return j.withColumn("jaccard", inter / union).where(F.col("jaccard") >= ratio)


class Engine:
    """Object API: recordings by id, project-wide scripts, results by command and strata."""

    def __init__(self, spark):
        self.spark, self.session = spark, None

    def attach(self, session) -> Engine:
        self.session = session
        return self

    def attach_edf(self, path: str, annots: str | None = None) -> Engine:
        from hypnoframe.plans.session import ANNOTS, Session
        from hypnoframe.sources import annotfile, edf

        recs, samples = edf.read(self.spark, path)
        notes = annotfile.read(self.spark, annots) if annots else self.spark.createDataFrame([], ANNOTS)
        self.session = Session(self.spark, samples, notes, recs)
        return self

    def eval(self, script: str) -> dict:
        self.session = self.session.eval(script)
        return self.session.results

    def commands(self) -> list[str]:
        return sorted({k for k, _ in self.session.results})

    def strata(self, cmd: str) -> list[tuple[str, ...]]:
        return sorted(f for k, f in self.session.results if k == cmd)

    def table(self, cmd: str, *factors: str) -> DataFrame:
        return self.session.table(cmd, *factors)

    def channels(self) -> DataFrame:
        return self.session.samples.select("id", "ch", "sr")

    def annots(self, classes: list[str] | None = None) -> DataFrame:
        a = self.session.annots
        return a.where(F.col("class").isin(classes)) if classes else a

    def slice(self, a_s: float, b_s: float, sig: str = "*") -> DataFrame:
        """(id, ch, t, x) of [a, b) seconds."""
        s = self.session.chosen(sig)
        v = F.slice("v", (F.floor(F.col("sr") * a_s) + 1).cast("int"), F.floor(F.col("sr") * (b_s - a_s)).cast("int"))
        return s.select("id", "ch", "sr", F.posexplode(v).alias("k", "x")).select("id", "ch", (F.col("k") / F.col("sr") + a_s).alias("t"), "x")

    def insert_signal(self, rid: str, ch: str, values, sr: float) -> Engine:
        from hypnoframe.plans.session import SAMPLES

        row = self.spark.createDataFrame([(rid, ch, float(sr), "", [float(v) for v in values])], SAMPLES)
        self.session = self.session.with_samples(self.session.samples.where(~((F.col("id") == rid) & (F.col("ch") == ch))).unionByName(row))
        return self

    def insert_annot(self, rid: str, name: str, intervals: list[tuple[float, float]]) -> Engine:
        rows = self.spark.createDataFrame([(rid, ".", float(a), float(b)) for a, b in intervals], "id string, ch string, start double, stop double")
        self.session = self.session.events(rows, name)
        return self

    def epochs2intervals(self, numbers: list[int]) -> DataFrame:
        return self.session.epochs.where(F.col("e").isin(numbers)).select("id", "e", "start_ns", "stop_ns")

    @staticmethod
    def seconds2intervals(pairs: list[tuple[float, float]]) -> list[tuple[int, int]]:
        return [(round(a * NS), round(b * NS)) for a, b in pairs]
