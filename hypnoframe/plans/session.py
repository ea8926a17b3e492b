"""Immutable session state and the machinery that commands share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypnoframe.plans.script import Command, ScriptError, parse

NS = 1_000_000_000
SAMPLES = "id string, ch string, sr double, unit string, v array<double>"
ANNOTS = "id string, class string, inst string, ch string, start_ns long, stop_ns long, meta map<string,string>"
COMMANDS: dict[str, Callable[[Session, Command], Session]] = {}
#: fixed values: commands that still run once everything is masked
WHEN_EMPTY = {"THAW", "TAG", "HEADERS", "SET-VAR", "SET-HEADERS", "DESC", "ALIASES", "TYPES", "PREDICT", "REPORT"}


def command(*names: str):
    def add(f):
        for n in names:
            COMMANDS[n] = f
        return f

    return add


@dataclass(frozen=True)
class Session:
    """Recordings as DataFrames; each command gives a new session.

    ``samples`` has a row per recording and channel with its whole trace, so what a
    channel needs is in one row and per-channel commands never shuffle.
    """

    spark: SparkSession
    samples: DataFrame
    annots: DataFrame
    recordings: DataFrame
    epochs: DataFrame | None = None
    chep: DataFrame | None = None
    results: dict[tuple[str, tuple[str, ...]], DataFrame] = field(default_factory=dict)
    variables: dict[str, str] = field(default_factory=dict)
    caches: dict[str, DataFrame] = field(default_factory=dict)
    frozen: dict[str, Session] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    hidden: frozenset = frozenset()
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    #: contiguous stretches (id, seg, start_ns, stop_ns) of recordings with gaps; traces hold them end to end
    segments: DataFrame | None = None
    stopped: bool = False

    # -- construction

    @staticmethod
    def create(spark: SparkSession, signals: dict[str, dict[str, tuple[float, np.ndarray]]], annots: list[tuple] = (), start: str = "1985-01-01 22:00:00") -> Session:
        """From arrays: {id: {channel: (rate, values)}} and (id, class, start_s, stop_s) rows."""
        rows = [(i, ch, float(sr), "uV", np.asarray(v, float).tolist()) for i, chs in signals.items() for ch, (sr, v) in chs.items()]
        durs = [(i, start, int(max((len(v) / sr for sr, v in chs.values()), default=0) * NS), NS) for i, chs in signals.items()]
        notes = [(i, c, c, ".", round(a * NS), round(b * NS), {}) for i, c, a, b in annots]
        return Session(spark, spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(notes, ANNOTS), spark.createDataFrame(durs, "id string, start string, dur_ns long, rec_ns long"))

    @staticmethod
    def empty(spark: SparkSession, ids: list[str], nr: int, rs: float) -> Session:
        """Recordings of ``nr`` records of ``rs`` seconds without signals."""
        s = Session.create(spark, {}, [])
        return replace(s, recordings=spark.createDataFrame([(i, "1985-01-01 22:00:00", round(nr * rs * NS), round(rs * NS)) for i in ids], "id string, start string, dur_ns long, rec_ns long"))

    def aliased(self, signals: dict[str, str] | None = None, annots: dict[str, str] | None = None) -> Session:
        """Channels (without case) and annotation classes under their primary names: {alias: name}."""
        sig, notes = {k.upper(): v for k, v in (signals or {}).items()}, annots or {}
        table = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
        samples = self.samples.withColumn("ch", F.coalesce(table(sig)[F.upper("ch")], F.col("ch"))) if sig else self.samples
        classes = self.annots.withColumn("class", F.coalesce(table(notes)[F.col("class")], F.col("class"))) if notes else self.annots
        return replace(self, samples=samples, annots=classes, aliases={"signal": self.aliases.get("signal", {}) | (signals or {}), "annot": self.aliases.get("annot", {}) | notes})

    def only(self, include: list[str] | None = None, exclude: list[str] | None = None) -> Session:
        """The recordings whose ids are listed, or are not."""
        hit = (F.col("id").isin(include) if include else F.lit(True)) & (~F.col("id").isin(exclude) if exclude else F.lit(True))
        cut = lambda d: d.where(hit) if d is not None else None
        return replace(self, samples=cut(self.samples), annots=cut(self.annots), recordings=cut(self.recordings), epochs=cut(self.epochs), chep=cut(self.chep), segments=cut(self.segments))

    # -- running

    def eval(self, text: str) -> Session:
        """Runs a script; an unknown command or bad parameter raises ScriptError."""
        s, variables = self, dict(self.variables)
        for c in parse(text, variables):
            s = replace(s, variables={**s.variables, **variables})
            if s.stopped:
                break
            if c.name not in COMMANDS:
                raise ScriptError(f"unknown command {c.name}")
            s = COMMANDS[c.name](s, c)
        return s

    def table(self, cmd: str, *factors: str) -> DataFrame:
        return self.results[cmd, tuple(factors)]

    def emit(self, cmd: str, df: DataFrame, *factors: str) -> Session:
        if cmd in self.hidden:
            return self
        for k, v in self.tags.items():
            df = df.withColumn(k, F.lit(v))
        key = (cmd, tuple(factors))
        old = self.results.get(key)
        return replace(self, results={**self.results, key: old.unionByName(df, allowMissingColumns=True) if old is not None else df})

    # -- channels

    def matching(self, sig: str | None, col: str = "ch") -> Column:
        """Channels of a ``sig`` list: ``*``, exact names without case, ``X*`` prefixes; of ``A|B`` the first that a recording has.

        With ``|`` it is a window expression over the recording, so it can stand in
        withColumn but not in where (see ``chosen``).
        """
        up, hit = F.upper(F.col(col)), F.lit(False)

        def named(n: str) -> Column:
            return up.startswith(n[:-1].upper()) if n.endswith("*") else up == n.upper()

        parts = [[n for n in part.split("|") if n] for part in (sig or "*").split(",")]
        if ["*"] in parts:
            return F.lit(True)
        for names in filter(None, parts):
            if len(names) == 1:
                hit = hit | named(names[0])
                continue
            rank = F.coalesce(*(F.when(named(n), k) for k, n in enumerate(names)))
            hit = hit | F.coalesce(rank == F.min(rank).over(Window.partitionBy("id")), F.lit(False))
        return hit

    def chosen(self, sig: str | None, yes: bool = True) -> DataFrame:
        """The traces that ``sig`` names, or all others."""
        hit = self.matching(sig)
        if "|" not in (sig or ""):
            return self.samples.where(hit if yes else ~hit)
        return self.samples.withColumn("_hit", hit).where("_hit" if yes else "not _hit").drop("_hit")

    def channels(self, c: Command, key: str = "sig") -> DataFrame:
        return self.chosen(c.get(key))

    def with_samples(self, df: DataFrame) -> Session:
        return replace(self, samples=df.select("id", "ch", "sr", "unit", "v"))

    def native(self, c: Command, f: Callable[[Column], Column]) -> Session:
        """Replaces the matched traces by an array expression (no Python, no shuffle)."""
        return self.with_samples(self.samples.withColumn("v", F.when(self.matching(c.get("sig")), f(F.col("v"))).otherwise(F.col("v"))))

    def mapped(self, c: Command, f: Callable[[np.ndarray, float], tuple[np.ndarray, float] | np.ndarray], keep: bool = False, name: Callable[[str], str] | None = None) -> Session:
        """Applies a kernel to each matched trace; with ``keep`` the result is a new channel."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = [f(np.asarray(v, float), sr) for v, sr in zip(p["v"], p["sr"], strict=True)]
                out = [o if isinstance(o, tuple) else (o, sr) for o, sr in zip(out, p["sr"], strict=True)]
                yield p.assign(v=[np.asarray(o[0], float) for o in out], sr=[float(o[1]) for o in out], ch=[name(x) if name else x for x in p["ch"]])

        new = self.channels(c).mapInPandas(run, SAMPLES)
        return self.with_samples((self.samples if keep else self.chosen(c.get("sig"), False)).unionByName(new))

    def expanded(self, c: Command, f: Callable[[str, np.ndarray, float], list[tuple[str, np.ndarray, float]]]) -> Session:
        """Adds the channels that a kernel makes from each matched one."""

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = [(i, name, float(sr2), u, np.asarray(y, float)) for i, ch, sr, u, v in p[["id", "ch", "sr", "unit", "v"]].itertuples(index=False) for name, y, sr2 in f(ch, np.asarray(v, float), sr)]
                yield pd.DataFrame(rows, columns=["id", "ch", "sr", "unit", "v"])

        return self.with_samples(self.samples.unionByName(self.channels(c).mapInPandas(run, SAMPLES)))

    def rows(self, c: Command, f: Callable[[np.ndarray, float], list[dict]], schema: str, key: str = "sig") -> DataFrame:
        """Result rows (id, ch, + schema) of a kernel over whole traces."""
        cols = [x.split()[0] for x in schema.split(",")]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = [(i, ch, *(r.get(k) for k in cols)) for i, ch, sr, v in p[["id", "ch", "sr", "v"]].itertuples(index=False) for r in f(np.asarray(v, float), sr)]
                yield pd.DataFrame(out, columns=["id", "ch", *cols])

        return self.channels(c, key).mapInPandas(run, f"id string, ch string, {schema}")

    def epoch_rows(self, c: Command, f: Callable[[np.ndarray, float], list[dict]], schema: str) -> DataFrame:
        """Result rows (id, ch, e, + schema) of a kernel over each unmasked epoch (the whole trace without epochs)."""
        cols = [x.split()[0] for x in schema.split(",")]
        if self.epochs is None:
            raise ScriptError(f"{c.name} needs EPOCH first")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                out = []
                for i, ch, sr, v, g in p[["id", "ch", "sr", "v", "grid"]].itertuples(index=False):
                    x = np.asarray(v, float)
                    for q in g:
                        part = x[round(q["start_ns"] * sr / NS) : round(q["stop_ns"] * sr / NS)]
                        if len(part):
                            out += [(i, ch, q["e"], *(r.get(k) for k in cols)) for r in f(part, sr)]
                yield pd.DataFrame(out, columns=["id", "ch", "e", *cols])

        return self.gridded(self.channels(c)).mapInPandas(run, f"id string, ch string, e long, {schema}")

    def gridded(self, traces: DataFrame) -> DataFrame:
        """Traces with ``grid``, the unmasked epochs of their recording in order, and ``step``, the least length of all its epochs."""
        # in a recording with gaps an epoch's place in the trace isn't its time
        at = F.col("pos_ns") if "pos_ns" in self.epochs.columns else F.col("start_ns")
        span = F.struct("e", at.alias("start_ns"), (at + F.col("stop_ns") - F.col("start_ns")).alias("stop_ns"))
        grid = self.epochs.groupBy("id").agg(F.sort_array(F.collect_list(F.when(~F.col("masked"), span))).alias("grid"), F.min(F.col("stop_ns") - F.col("start_ns")).alias("step"))
        # the grids are the smaller side, and no trace is sorted; traces dealt by id already stay where they are
        return traces.join(self.dealt(grid.where(F.size("grid") > 0)).hint("shuffle_hash"), "id")

    def dealt(self, df: DataFrame) -> DataFrame:
        """Rows by id, dealt by number: traces are small but costly to work on, so they mustn't be coalesced by size into few tasks."""
        return df.repartition(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "id")

    def by_recording(self, df: DataFrame):
        return self.dealt(df).groupBy("id")

    def grouped(self, c: Command, f: Callable[[str, dict[str, tuple[float, np.ndarray]]], list[dict]], schema: str, keys=("sig",)) -> DataFrame:
        """Result rows (+ schema) of a kernel over all matched channels of a recording; it returns dicts or a data frame."""
        cols = [x.split()[0] for x in schema.split(",")]
        sig = ",".join(c.get(k, "*") for k in keys if c.has(k) or len(keys) == 1)

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("ch")
            chs = {ch: (sr, np.asarray(v, float)) for ch, sr, v in p[["ch", "sr", "v"]].itertuples(index=False)}
            got = f(p["id"].iloc[0], chs)
            if isinstance(got, pd.DataFrame):
                return got.assign(id=p["id"].iloc[0])[["id", *cols]]
            return pd.DataFrame([[p["id"].iloc[0], *(r.get(k) for k in cols)] for r in got], columns=["id", *cols])

        return self.by_recording(self.chosen(sig)).applyInPandas(run, f"id string, {schema}")

    def pairs(self, c: Command, f: Callable[[np.ndarray, np.ndarray, float], list[dict]], schema: str, once: Callable[[np.ndarray, float], object] | None = None) -> DataFrame:
        """Result rows (id, ch1, ch2, + schema) of channel pairs of equal rate; sig1 x sig2, or all pairs of sig.

        A recording's traces meet once, in one group, and the kernel runs over their
        pairs: no trace is shuffled or copied for each pair.  ``once`` is done to each
        trace, and the kernel gets what it returns.
        """
        left, right = c.get("sig1"), c.get("sig2")
        cols = [x.split()[0] for x in schema.split(",")]
        one, two = self.matching(left or c.get("sig")), self.matching(right or c.get("sig"))

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("ch", kind="stable")
            rows = [(ch, sr, np.asarray(v, float), a, b) for ch, sr, v, a, b in p[["ch", "sr", "v", "_a", "_b"]].itertuples(index=False)]
            rows = [(ch, sr, once(v, sr), a, b) for ch, sr, v, a, b in rows] if once else rows
            rid = p["id"].iloc[0]
            out = [(rid, x[0], y[0], *(r.get(k) for k in cols)) for x in rows if x[3] for y in rows if y[4] and x[1] == y[1] and (x[0] != y[0] if left else x[0] < y[0]) for r in f(x[2], y[2], x[1])]
            return pd.DataFrame(out, columns=["id", "ch1", "ch2", *cols])

        both = self.samples.withColumns({"_a": one, "_b": two}).where("_a or _b").select("id", "ch", "sr", "v", "_a", "_b")
        return self.by_recording(both).applyInPandas(run, f"id string, ch1 string, ch2 string, {schema}")

    def joint(self, c: Command, f: Callable[[dict[str, tuple[float, np.ndarray]]], dict[str, tuple[float, np.ndarray]]], keep: bool = True) -> Session:
        """New channels from all matched channels of a recording together."""

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("ch")
            out = f({ch: (sr, np.asarray(v, float)) for ch, sr, v in p[["ch", "sr", "v"]].itertuples(index=False)})
            return pd.DataFrame([(p["id"].iloc[0], ch, float(sr), p["unit"].iloc[0], np.asarray(v, float)) for ch, (sr, v) in out.items()], columns=["id", "ch", "sr", "unit", "v"])

        new = self.by_recording(self.channels(c)).applyInPandas(run, SAMPLES)
        old = self.samples if keep else self.chosen(c.get("sig"), False)
        return self.with_samples(old.unionByName(new))

    # -- annotations

    def events(self, df: DataFrame, name: str, start: str = "start", stop: str = "stop") -> Session:
        """Adds rows (id, ch, start, stop in seconds) as annotations."""
        new = df.select("id", F.lit(name).alias("class"), F.lit(name).alias("inst"), "ch", F.round(F.col(start) * NS).cast("long").alias("start_ns"), F.round(F.col(stop) * NS).cast("long").alias("stop_ns"), F.create_map().cast("map<string,string>").alias("meta"))
        return replace(self, annots=self.annots.unionByName(new))

    @staticmethod
    def in_class(names: list[str]) -> Column:
        """Whether a row's class is one of ``names`` (``X*``: begins with X)."""
        hit = F.lit(False)
        for n in names:
            hit = hit | (F.col("class").startswith(n[:-1]) if n.endswith("*") else F.col("class") == n)
        return hit

    def of_class(self, names: list[str]) -> DataFrame:
        return self.annots.where(self.in_class(names))
