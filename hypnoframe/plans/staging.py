"""Staging commands with models: boosted trees, trainer libraries, re-epoching, completion, permutation-pattern neighbours."""

from __future__ import annotations

import math
import pickle
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.functions import boost, dsp
from hypnoframe.operators import epochs as ep
from hypnoframe.operators import hypno
from hypnoframe.plans.commands import _ensured
from hypnoframe.plans.script import Command, ScriptError
from hypnoframe.plans.session import Session, command

BANDS = ["DELTA", "THETA", "ALPHA", "SIGMA", "BETA"]
#: rows of a library (trainers, or epochs with their patterns) and epochs that a model learns from, at most
MOST_TRAINERS, MOST_ROWS = 10_000, 200_000
PRED = "id string, e long, PRIOR string, PRED string, MAXPP double"


def features(s: Session, c: Command) -> DataFrame:
    """id, e, x: log band powers of the matched channels, in the order of their names."""

    def one(x, sr):
        f, p = dsp.welch(x, sr)
        return [{b: math.log(dsp.band_power(f, p, *dsp.BANDS[b]) + 1e-12) for b in BANDS}]

    rows = s.epoch_rows(c, one, ", ".join(f"{b} double" for b in BANDS))
    x = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ch", F.array(*BANDS).alias("x")))), lambda r: r["x"]))
    return rows.groupBy("id", "e").agg(x.alias("x"))


def labelled(s: Session, c: Command) -> DataFrame:
    """id, e, x, stage (? where there is none)."""
    return features(s, c).join(hypno.staged(s.epochs, s.annots).select("id", "e", "stage"), ["id", "e"])


def agreement(y: np.ndarray, z: np.ndarray) -> float:
    """Cohen's kappa."""
    names = sorted(set(y) | set(z))
    po = float(np.mean(y == z))
    pe = float(sum(np.mean(y == k) * np.mean(z == k) for k in names))
    return (po - pe) / (1 - pe) if pe < 1 else 1.0


def _summary(s: Session, name: str, rows: DataFrame) -> Session:
    """The epochs and, by recording, accuracy and kappa against the stages that were known."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        q = p[p["PRIOR"] != "?"]
        y, z = q["PRIOR"].to_numpy(), q["PRED"].to_numpy()
        return pd.DataFrame([(p["id"].iloc[0], len(q), float(np.mean(y == z)) if len(q) else None, agreement(y, z) if len(q) else None)], columns=["id", "NE", "ACC", "K"])

    return s.emit(name, rows, "E").emit(name, rows.groupBy("id").applyInPandas(one, "id string, NE long, ACC double, K double"))


def _predicted(p: pd.DataFrame, names: list, post: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": p["id"], "e": p["e"], "PRIOR": p["stage"], "PRED": [names[i] for i in post.argmax(1)], "MAXPP": post.max(1)})


@command("COMPLETE")
def complete(s: Session, c: Command) -> Session:
    """Stages of all epochs from those that are known: ``scrub`` forgets all but the ``pick`` first of each stage (by a hash), ``epoch=1,2 stage=X`` sets some."""
    s = _ensured(s)
    d = labelled(s, c)
    if c.has("epoch"):
        d = d.withColumn("stage", F.when(F.col("e").isin([int(x) for x in c.list("epoch")]), F.lit(c.get("stage", "?"))).otherwise(F.col("stage")))
    pick, scrub = int(c.num("pick", 5)), c.has("scrub") or c.has("pick")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("e").reset_index(drop=True)
        x, y = np.array(p["x"].tolist()), p["stage"].to_numpy()
        known = y != "?"
        if scrub:
            order = np.random.default_rng(1).permutation(len(y))
            known = np.zeros(len(y), bool)
            for k in set(y) - {"?"}:
                known[[i for i in order if y[i] == k][:pick]] = True
        if len(set(y[known])) < 2:
            return p.assign(PRIOR=y, PRED=y, MAXPP=1.0)[["id", "e", "PRIOR", "PRED", "MAXPP"]]
        return _predicted(p, *dsp.lda(x[known], y[known], x))

    return _summary(s, "COMPLETE", d.groupBy("id").applyInPandas(one, PRED))


@command("REBASE")
def rebase(s: Session, c: Command) -> Session:
    """Stages at another epoch length (``dur``): a model of the recording's own epochs predicts the new ones."""
    s = _ensured(s)
    old = labelled(s, c).where("stage != '?'")
    new = features(replace(s, epochs=ep.epochs(s.recordings.select("id", "dur_ns"), c.num("dur", 5.0), c.num("inc"))), c)

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("e").reset_index(drop=True).assign(stage="?")
        if not len(b) or a["stage"].nunique() < 2:
            return pd.DataFrame(columns=["id", "e", "PRIOR", "PRED", "MAXPP"])
        return _predicted(b, *dsp.lda(np.array(a["x"].tolist()), a["stage"].to_numpy(), np.array(b["x"].tolist())))

    return s.emit("REBASE", old.groupBy("id").cogroup(new.groupBy("id")).applyInPandas(one, PRED), "E")


@command("MAKE-SUDS")
def make_suds(s: Session, c: Command) -> Session:
    """A library of trainers: their epochs' features and stages, as cache ``suds`` and, with ``db``, as Parquet."""
    s = _ensured(s)
    lib = labelled(s, c).where("stage != '?'")
    if c.has("db"):
        lib.write.mode("overwrite").parquet(c.get("db"))
        lib = s.spark.read.parquet(c.get("db"))
    n = lib.groupBy("id").agg(F.count("*").alias("NE"), F.countDistinct("stage").alias("NS"))
    return replace(s, caches={**s.caches, "suds": lib}).emit("MAKE-SUDS", n)


@command("SUDS")
def suds(s: Session, c: Command) -> Session:
    """Stages by all trainers but the recording itself: each trainer's posteriors count by how sure they are.

    The trainers' models (a mean by stage and one covariance each) go to every task;
    a library of more than MOST_TRAINERS is refused.
    """
    s = _ensured(s)
    lib = s.spark.read.parquet(c.get("db")) if c.has("db") else s.caches.get("suds")
    if lib is None:
        raise ScriptError("SUDS needs db, or MAKE-SUDS before it")
    if lib.select("id").distinct().count() > MOST_TRAINERS:
        raise ScriptError(f"SUDS: more than {MOST_TRAINERS} trainers")

    def model(p: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(p["x"].tolist()), p["stage"].to_numpy()
        names = sorted(set(y))
        mu = np.array([x[y == k].mean(0) for k in names])
        w = sum((x[y == k] - m).T @ (x[y == k] - m) for k, m in zip(names, mu, strict=True)) / max(1, len(x) - len(names))
        si = np.linalg.pinv(w + 1e-6 * np.trace(w) / len(w) * np.eye(len(w)) + 1e-12 * np.eye(len(w)))
        return pd.DataFrame([(p["id"].iloc[0], pickle.dumps((names, mu, si)))], columns=["id", "m"])

    models = [(r["id"], pickle.loads(r["m"])) for r in lib.groupBy("id").applyInPandas(model, "id string, m binary").collect()]
    names = sorted({k for _, (own, _, _) in models for k in own})
    sent = s.spark.sparkContext.broadcast((models, names))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("e").reset_index(drop=True)
        models, names = sent.value
        x = np.array(p["x"].tolist())
        total = np.full((len(x), len(names)), 1e-9)
        for i, (own, mu, si) in models:
            if i == p["id"].iloc[0] or mu.shape[1] != x.shape[1]:
                continue
            z = x @ si @ mu.T - 0.5 * np.einsum("ij,jk,ik->i", mu, si, mu)
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            total[:, [names.index(k) for k in own]] += q * q.max(1).mean()
        return _predicted(p, names, total / total.sum(1, keepdims=True))

    return _summary(s, "SUDS", labelled(s, c).groupBy("id").applyInPandas(one, PRED)) if names else s


@command("POPS", "RUN-POPS")
def pops(s: Session, c: Command) -> Session:
    """Stages by boosted trees: ``train`` fits them on the staged epochs (cache ``pops``), else they predict; ``model`` is a LightGBM text file for classes ``stages``.

    Training takes at most MOST_ROWS epochs, chosen by a hash.
    """
    s = _ensured(s)
    if c.has("train"):
        d = labelled(s, c).where("stage != '?'")
        share = min(1.0, MOST_ROWS / max(1, d.count()))
        rows = d.where(F.pmod(F.xxhash64("id", "e"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "e", "x", "stage").toPandas().sort_values(["id", "e"])
        if rows["stage"].nunique() < 2:
            raise ScriptError("POPS: two stages are needed to learn from")
        model = boost.fit(np.array(rows["x"].tolist()), rows["stage"].to_numpy(), int(c.num("rounds", 40)), int(c.num("depth", 3)))
        return replace(s, caches={**s.caches, "pops": s.spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "m binary")}).emit("POPS-TRAIN", s.spark.createDataFrame([(len(rows), len(model.trees))], "NE long, TREES long"))
    if c.has("model"):
        text = "\n".join(r["value"] for r in s.spark.read.text(c.get("model"), wholetext=True).collect())
        model = boost.parsed(text, c.list("stages", "N1,N2,N3,R,W"))
    elif "pops" in s.caches:
        model = pickle.loads(s.caches["pops"].first()["m"])
    else:
        raise ScriptError("POPS needs model, or POPS train before it")
    sent = s.spark.sparkContext.broadcast(model)

    def run(parts):
        for p in parts:
            if len(p):
                yield _predicted(p, sent.value.classes, sent.value.predict(np.array(p["x"].tolist())))

    return _summary(s, "POPS", labelled(s, c).select("id", "e", "x", "stage").mapInPandas(run, PRED))


def patterns(x: np.ndarray, m: int = 3, t: int = 1) -> list[float]:
    """Shares of the orders in which m values, t apart, can stand."""
    w = np.lib.stride_tricks.sliding_window_view(x, (m - 1) * t + 1)[:, ::t]
    return (np.bincount(np.argsort(w, 1, kind="stable") @ (m ** np.arange(m)), minlength=m**m) / len(w)).tolist()


def _pattern_rows(s: Session, c: Command) -> DataFrame:
    m, t = int(c.num("m", 3)), int(c.num("t", 1))
    rows = s.epoch_rows(c, lambda x, sr: [{"x": patterns(x, m, t)}] if len(x) > (m - 1) * t else [], "x array<double>")
    x = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda r: r["x"]))
    return rows.groupBy("id", "e").agg(x.alias("x")).join(hypno.staged(s.epochs, s.annots).select("id", "e", "stage"), ["id", "e"])


@command("TSLIB")
def tslib(s: Session, c: Command) -> Session:
    """A library of permutation-pattern distributions of staged epochs, as cache ``tslib`` and, with ``ts-lib``, as Parquet."""
    s = _ensured(s)
    lib = _pattern_rows(s, c).where("stage != '?'")
    if c.has("ts-lib"):
        lib.write.mode("overwrite").parquet(c.get("ts-lib"))
        lib = s.spark.read.parquet(c.get("ts-lib"))
    return replace(s, caches={**s.caches, "tslib": lib}).emit("TSLIB", lib.groupBy("stage").agg(F.count("*").alias("N")), "SS")


@command("SSS")
def sss(s: Session, c: Command) -> Session:
    """Stage of each epoch by a vote of the ``top`` library epochs whose pattern distributions are nearest (symmetric divergence), the recording's own left out."""
    s = _ensured(s)
    lib = s.spark.read.parquet(c.get("pd-lib")) if c.has("pd-lib") else s.caches.get("tslib")
    if lib is None:
        raise ScriptError("SSS needs pd-lib, or TSLIB before it")
    if lib.count() > MOST_ROWS:
        raise ScriptError(f"SSS: a library of more than {MOST_ROWS} epochs")
    rows = lib.select("id", "e", "x", "stage").toPandas().sort_values(["id", "e"])
    sent, top = s.spark.sparkContext.broadcast((rows["id"].to_numpy(), np.array(rows["x"].tolist()), rows["stage"].to_numpy())), int(c.num("top", 10))

    def run(parts):
        ids, lx, ly = sent.value
        for p in parts:
            out = []
            for i, e, x, stage in p[["id", "e", "x", "stage"]].itertuples(index=False):
                other = ids != i
                if not other.any():
                    continue
                a, b = np.asarray(x) + 1e-6, lx[other] + 1e-6
                d = ((a - b) * np.log(a / b)).sum(1)
                votes = pd.Series(ly[other][np.argsort(d, kind="stable")[:top]]).value_counts().sort_index()
                out.append((i, e, stage, votes.idxmax(), float(votes.max() / votes.sum())))
            yield pd.DataFrame(out, columns=["id", "e", "PRIOR", "PRED", "MAXPP"])

    return _summary(s, "SSS", _pattern_rows(s, c).select("id", "e", "x", "stage").mapInPandas(run, PRED))
