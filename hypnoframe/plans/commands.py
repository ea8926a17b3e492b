"""Commands over recordings: tables, channels, epochs, masks, annotations, staging."""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.functions.expr import compiled, names_in
from hypnoframe.operators import epochs as ep
from hypnoframe.operators import hypno
from hypnoframe.operators import intervals as iv
from hypnoframe.plans.script import Command, ScriptError
from hypnoframe.plans.session import NS, SAMPLES, Session, command

# ---- session, sinks, tables ----------------------------------------------


@command("WRITE")
def write(s: Session, c: Command) -> Session:
    """Writes the traces as EDF files (edfz: block-compressed, indexed), one per recording, under edf-dir (default: parquet under out)."""
    from hypnoframe.sources import edf

    if c.has("edf-dir"):
        edf.write(s, c.get("edf-dir"), c.get("edf-tag", ""), c.has("edfz"))
    elif c.has("out"):
        s.samples.write.mode("overwrite").partitionBy("id").parquet(c.get("out"))
    return s


@command("WRITE-ANNOTS")
def write_annots(s: Session, c: Command) -> Session:
    from hypnoframe.sources import annotfile

    annotfile.write(s.of_class(c.list("annot", "*") or ["*"]), c.get("file"))
    return s


@command("SUMMARY", "DESC")
def summary(s: Session, c: Command) -> Session:
    return s.emit(c.name, s.samples.groupBy("id").agg(F.count("*").alias("NS"), F.sort_array(F.collect_list("ch")).alias("SIGNALS")))


@command("HEADERS")
def headers(s: Session, c: Command) -> Session:
    base = s.recordings.join(s.samples.groupBy("id").agg(F.count("*").alias("NS")), "id", "left").select("id", F.coalesce("NS", F.lit(0)).alias("NS"), (F.col("dur_ns") / F.col("rec_ns")).cast("long").alias("NR"), (F.col("rec_ns") / NS).alias("REC_DUR"), (F.col("dur_ns") / NS).alias("TOT_DUR_SEC"), F.col("start").alias("START_TIME"))
    ch = s.channels(c).select("id", "ch", F.col("sr").alias("SR"), F.col("unit").alias("PDIM"), F.array_min("v").alias("PMIN"), F.array_max("v").alias("PMAX"))
    return s.emit("HEADERS", base).emit("HEADERS", ch, "CH")


@command("STATS")
def statistics(s: Session, c: Command) -> Session:
    """Whole-trace statistics, and with ``epoch`` those of unmasked epochs with their means and lower medians."""

    def one(x, sr):
        n, m, sd = len(x), x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0
        srt = np.sort(x)
        r = {"N": n, "MEAN": m, "SD": sd, "RMS": np.sqrt((x * x).mean()), "MIN": srt[0], "MAX": srt[-1], "MEDIAN": srt[(n - 1) // 2]}
        z = x - m
        r["SKEW"] = float((z**3).mean() / sd**3) if sd else 0.0
        r["KURT"] = float((z**4).mean() / (z * z).mean() ** 2 - 3) + 3 * c.yes("kurt3") if sd else 0.0
        return [r | {f"P{int(100 * q):02}": srt[min(n - 1, int(n * q))] for q in (0.01, 0.05, 0.25, 0.75, 0.95, 0.99)}]

    schema = "N long, MEAN double, SD double, RMS double, MIN double, MAX double, MEDIAN double, SKEW double, KURT double, " + ", ".join(f"P{q:02} double" for q in (1, 5, 25, 75, 95, 99))
    s = s.emit("STATS", s.rows(c, one, schema).drop("MEDIAN"), "CH")
    if not c.has("epoch"):
        return s
    e = s.epoch_rows(c, one, schema)
    md = lambda v: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v})")
    both = e.groupBy("id", "ch").agg(F.count("*").alias("NE1"), *(md(v).alias(f"{v}_MD") for v in ("MEAN", "MEDIAN", "RMS", "SKEW", "KURT")), *(F.avg(v).alias(f"{v}_MN") for v in ("RMS", "SKEW", "KURT")))
    return s.emit("STATS", e, "CH", "E").emit("STATS-EPOCH", both, "CH")


@command("READ", "TIME-TRACK", "DROP-TIMESTAMPS")
def no_op(s: Session, c: Command) -> Session:
    """Nothing to do here: DataFrames are lazy, continuous and carry their own time."""
    return s


@command("REPORT")
def report(s: Session, c: Command) -> Session:
    hide, show = set(c.list("hide")), set(c.list("show"))
    return replace(s, hidden=frozenset((s.hidden | hide) - show))


@command("SET-VAR")
def set_var(s: Session, c: Command) -> Session:
    return replace(s, variables={**s.variables, **{k: v or "" for k, v in c.params.items()}})


@command("VARS")
def show_vars(s: Session, c: Command) -> Session:
    return s.emit("VARS", s.spark.createDataFrame([(k, v) for k, v in s.variables.items()], "VAR string, VAL string"), "VAR")


@command("TAG")
def tag(s: Session, c: Command) -> Session:
    if not c.params:
        raise ScriptError("TAG needs level/factor")
    level, factor = next(iter(c.params.items())) if "tag" not in c.params else (c.get("tag").split("/")[::-1] + [None])[:2]
    return replace(s, tags={**s.tags, str(factor or "TAG"): level})


@command("SET-HEADERS")
def set_headers(s: Session, c: Command) -> Session:
    if c.has("unit"):
        s = s.with_samples(s.samples.withColumn("unit", F.when(s.matching(c.get("sig")), F.lit(c.get("unit"))).otherwise(F.col("unit"))))
    if c.has("start-time"):
        s = replace(s, recordings=s.recordings.withColumn("start", F.lit(c.get("start-time"))))
    return s


@command("ANON")
def anon(s: Session, c: Command) -> Session:
    """Blanks start times; ``root`` renames recordings root_1, root_2, ..."""
    s = replace(s, recordings=s.recordings.withColumn("start", F.lit("1985-01-01 00:00:00")))
    if not c.has("root"):
        return s
    names = s.recordings.select("id", F.concat(F.lit(c.get("root") + "_"), F.row_number().over(Window.orderBy("id"))).alias("_n"))  # a row per recording
    re = lambda d: d.join(names, "id").withColumn("id", F.col("_n")).drop("_n")
    return replace(s, recordings=re(s.recordings), samples=re(s.samples), annots=re(s.annots), epochs=re(s.epochs) if s.epochs is not None else None)


@command("FREEZE")
def freeze(s: Session, c: Command) -> Session:
    return replace(s, frozen={**s.frozen, c.get("tag", next(iter(c.params), "F")): s})


@command("THAW")
def thaw(s: Session, c: Command) -> Session:
    name = c.get("tag", next(iter(c.params), "F"))
    if name not in s.frozen:
        if c.yes("strict"):
            raise ScriptError(f"nothing frozen as {name}")
        return s
    kept = {k: v for k, v in s.frozen.items() if not (c.yes("remove") and k == name)}
    return replace(s.frozen[name], results=s.results, frozen=kept, caches=s.caches)


@command("CLEAN-FREEZER")
def clean_freezer(s: Session, c: Command) -> Session:
    return replace(s, frozen={})


@command("EXIT", "STOP", "QUIT")
def stop(s: Session, c: Command) -> Session:
    if c.has("if-empty") and s.epochs is not None and s.epochs.where("not masked").limit(1).count():
        return s
    return replace(s, stopped=True)


@command("REQUIRES")
def requires(s: Session, c: Command) -> Session:
    if tuple(int(n) for n in c.get("version", "v0").lstrip("v").split(".")) > (1, 0, 0):
        raise ScriptError(f"version {c.get('version')} is required")
    return s


@command("DUMP", "MATRIX", "HEAD", "DUMP-RECORDS")
def dump(s: Session, c: Command) -> Session:
    """Samples as rows (id, ch, t, x); MATRIX and HEAD pivot channels of one rate into columns."""
    d = s.channels(c)
    kinds = d.select("ch", "sr").distinct().collect() if c.name in ("MATRIX", "HEAD") else []
    names, whole = sorted({r["ch"] for r in kinds}), kinds and len({r["sr"] for r in kinds}) == 1
    if whole:
        # of one rate: the traces of a recording meet before they become rows
        d = s.dealt(d).groupBy("id", "sr").pivot("ch", names).agg(F.first("v"))
        d = d.select("id", "sr", F.posexplode(F.arrays_zip(*(F.coalesce(F.col(f"`{n}`"), F.array().cast("array<double>")).alias(f"c{i}") for i, n in enumerate(names)))).alias("k", "r"))
        d = d.select("id", (F.col("k") / F.col("sr")).alias("t"), *(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))
    else:
        d = d.select("id", "ch", "sr", F.posexplode("v").alias("k", "x")).select("id", "ch", (F.col("k") / F.col("sr")).alias("t"), "x")
    if c.name == "HEAD" or c.has("epoch") and s.epochs is not None:
        e = s.epochs.where(F.col("e") == int(c.num("epoch", 1))).select("id", "start_ns", "stop_ns")
        d = d.join(e, "id").where("t * 1e9 >= start_ns and t * 1e9 < stop_ns").drop("start_ns", "stop_ns")
    if kinds and not whole:
        d = d.groupBy("id", "t").pivot("ch", names).agg(F.first("x"))
    return s.emit(c.name, d)


@command("CACHE")
def cache(s: Session, c: Command) -> Session:
    if c.has("clear"):
        return replace(s, caches={})
    if c.has("load"):
        return replace(s, caches={**s.caches, c.get("cache", "cache"): s.spark.read.parquet(c.get("load"))})
    return s.emit("CACHE", s.spark.createDataFrame([(k,) for k in s.caches], "NAME string"))


@command("A2C")
def a2c(s: Session, c: Command) -> Session:
    at = iv.reduce_to(s.of_class(c.list("annot")), "midpoint").select("id", "ch", (F.col("start_ns") / NS).alias("t"))
    return replace(s, caches={**s.caches, c.get("cache", "cache"): at})


@command("C2A")
def c2a(s: Session, c: Command) -> Session:
    w = c.num("w", 0.0)
    return s.events(s.caches[c.get("cache", "cache")].select("id", "ch", (F.col("t") - w).alias("start"), (F.col("t") + w).alias("stop")), c.get("annot", "cache"))


@command("RECORD-SIZE")
def regrid(s: Session, c: Command) -> Session:
    """Changes the record length; traces are continuous here, so only the header follows."""
    return replace(s, recordings=s.recordings.withColumn("rec_ns", F.lit(round(c.num("dur", 1.0) * NS))))


# ---- channels ------------------------------------------------------------


@command("SIGNALS")
def signals(s: Session, c: Command) -> Session:
    if c.has("keep") or c.has("req"):
        s = s.with_samples(s.chosen(c.get("keep", c.get("req"))))
    if c.has("drop"):
        s = s.with_samples(s.chosen(c.get("drop"), False))
    if c.has("pick"):
        order = F.array(*(F.lit(x.upper()) for x in c.list("pick")))
        rank = F.array_position(order, F.upper("ch"))
        first = F.row_number().over(Window.partitionBy("id").orderBy(rank)) == 1
        picked = s.samples.where(rank > 0).withColumn("_f", first)
        if c.has("rename"):
            picked = picked.withColumn("ch", F.lit(c.get("rename")))
        s = s.with_samples(s.samples.where(~s.matching(c.get("pick"))).unionByName(picked.where("_f").drop("_f")))
    return s


@command("RENAME")
def rename(s: Session, c: Command) -> Session:
    m = {a.upper(): b for a, b in zip(c.list("sig"), c.list("new"), strict=True)}
    table = F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    return s.with_samples(s.samples.withColumn("ch", F.coalesce(F.element_at(table, F.upper("ch")), F.col("ch"))))


@command("COPY")
def copy(s: Session, c: Command) -> Session:
    new = s.channels(c).withColumn("ch", F.lit(c.get("new")) if c.has("new") else F.concat(F.lit(c.get("pretag", "")), F.col("ch"), F.lit("_" + c.get("tag", "COPY") if not c.has("pretag") else "")))
    return s.with_samples(s.samples.unionByName(new))


@command("EMPTY")
def empty(s: Session, c: Command) -> Session:
    sr = c.num("sr")
    new = s.recordings.select("id", F.lit(c.get("sig")).alias("ch"), F.lit(sr).alias("sr"), F.lit("").alias("unit"), F.array_repeat(F.lit(0.0), F.round(F.col("dur_ns") / NS * sr).cast("int")).alias("v"))
    return s.with_samples(s.samples.unionByName(new))


@command("ORDER")
def order(s: Session, c: Command) -> Session:
    return s.with_samples(s.samples.orderBy("id", F.array_position(F.array(*(F.lit(x) for x in c.list("sig") or ["*"])), "ch"), "ch"))


@command("ENFORCE-SR")
def enforce_sr(s: Session, c: Command) -> Session:
    lo, hi = (float(x) for x in (c.list("sr") or ["0", "1e9"]))
    return s.with_samples(s.samples.where(F.col("sr").between(lo, hi) & ((F.col("sr") * c.num("dur", 1.0)) % 1 == 0)))


@command("CONTAINS")
def contains(s: Session, c: Command) -> Session:
    want = c.list("sig")
    got = s.channels(c).groupBy("id").agg(F.countDistinct("ch").alias("NS_OBS"))
    out = s.recordings.select("id").join(got, "id", "left").select("id", F.lit(len(want)).alias("NS_REQ"), F.coalesce("NS_OBS", F.lit(0)).alias("NS_OBS"))
    if c.has("annots"):
        notes = s.of_class(c.list("annots")).groupBy("id").agg(F.countDistinct("class").alias("NA_OBS"))
        out = out.join(notes, "id", "left").withColumn("NA_REQ", F.lit(len(c.list("annots"))))
    s = s.emit("CONTAINS", out)
    if c.has("skip"):
        ok = out.where("NS_OBS = NS_REQ").select("id")
        s = replace(s, samples=s.samples.join(ok, "id", "left_semi"), recordings=s.recordings.join(ok, "id", "left_semi"))
    return s


@command("CANONICAL")
def canonical(s: Session, c: Command) -> Session:
    """Rules ``cs=NEW:A|B,NEW2:C``: the first present source of each becomes the canonical channel."""
    for rule in c.list("cs"):
        new, sources = rule.split(":")
        s = signals(s, Command("SIGNALS", {"pick": sources.replace("|", ","), "rename": new}))
    return s.emit("CANONICAL", s.samples.select("id", F.col("ch").alias("CS"), F.lit(1).alias("DEFINED"), F.col("sr").alias("SR")), "CS")


@command("REMAP")
def remap(s: Session, c: Command) -> Session:
    m = dict(x.split(":") for x in c.list("map"))
    return replace(s, annots=s.annots.withColumn("class", F.coalesce(F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("class")], F.col("class"))) if m else s.annots)


@command("DROP-ANNOTS")
def drop_annots(s: Session, c: Command) -> Session:
    gone = s.of_class(c.list("annot"))
    return replace(s, annots=s.annots.join(gone.select("class").distinct(), "class", "left_anti").select(*s.annots.columns))


#: fixed values: channel types and the labels (upper case) that have them, the first that fits
CHANNEL_TYPES = (("EEG", "EEG|^[CFPOT][0-9Z]"), ("EOG", "EOG|LOC|ROC"), ("EMG", "EMG|CHIN|LEG"), ("ECG", "ECG|EKG"), ("OXY", "SAO2|SPO2"), ("RESP", "RESP|AIR|THOR|ABD|NASAL|FLOW"))


def channel_type(ch):
    kind = F.lit("UNKNOWN")
    for name, pattern in reversed(CHANNEL_TYPES):
        kind = F.when(F.upper(ch).rlike(pattern), name).otherwise(kind)
    return kind


@command("TYPES")
def types(s: Session, c: Command) -> Session:
    """The rules by which channels have types."""
    return s.emit("TYPES", s.spark.createDataFrame(list(CHANNEL_TYPES), "TYPE string, LABELS string"), "TYPE")


@command("CLOCS")
def clocs(s: Session, c: Command) -> Session:
    """Electrode positions from lines of label, x, y, z (blank, tab or comma between; # and % begin comments), kept as cache ``clocs``.

    Labels are upper-cased; a line of any other form stops the command.  The unit
    sphere's coordinates (azimuth and elevation in degrees, radius) stand beside.
    """
    if not c.has("file"):
        raise ScriptError("CLOCS needs file")
    lines = s.spark.read.text(c.get("file")).select(F.trim("value").alias("line")).where(~F.col("line").rlike("^([#%].*)?$"))
    part = F.split("line", r"[\t ,]+")
    x, y, z = (part[k].try_cast("double").alias(n) for k, n in ((1, "x"), (2, "y"), (3, "z")))
    table = lines.select(F.size(part).alias("parts"), F.upper(part[0]).alias("ch"), x, y, z)
    bad = table.where("parts != 4 or x is null or y is null or z is null").limit(1).count()
    if bad:
        raise ScriptError("CLOCS: a line isn't label, x, y, z")
    flat = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    table = table.select("ch", "x", "y", "z", F.degrees(F.atan2("y", "x")).alias("azimuth"), F.degrees(F.atan2(F.col("z"), flat)).alias("elevation"), F.sqrt(flat**2 + F.col("z") ** 2).alias("radius"))
    return replace(s, caches={**s.caches, "clocs": table}).emit("CLOCS", table, "CH")


@command("SEDF")
def summary_channels(s: Session, c: Command) -> Session:
    """A summary of each channel by epoch, as channels of one sample an epoch: Hjorth numbers (H1_, H2_, H3_) of EEG, EOG, EMG and ECG, else mean, least and greatest value (M_, L_, U_).

    Result SEDF by channel; with ``sedf-dir`` also written there as Parquet by recording.
    """

    s = _ensured(s)

    def run(parts):
        for p in parts:
            rows = []
            for i, ch, sr, v, g, step, hj in p[["id", "ch", "sr", "v", "grid", "step", "hj"]].itertuples(index=False):
                x = np.asarray(v, float)
                cuts = [q for q in (x[round(q["start_ns"] * sr / NS) : round(q["stop_ns"] * sr / NS)] for q in g) if len(q)]
                # epochs of one length side by side
                m = [np.array(cuts)] if len({len(q) for q in cuts}) == 1 else [q[None] for q in cuts]
                if cuts:
                    got = [dsp.hjorths(q) if hj else (q.mean(1), q.min(1), q.max(1)) for q in m]
                    rows += [(i, f"{k}_{ch}", NS / step, "", np.concatenate(z)) for k, z in zip(("H1", "H2", "H3") if hj else "MLU", zip(*got, strict=True), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "ch", "sr", "unit", "v"])

    d = s.gridded(s.channels(c)).withColumn("hj", channel_type(F.col("ch")).isin("EEG", "EOG", "EMG", "ECG"))
    traces = d.mapInPandas(run, SAMPLES)
    if c.has("sedf-dir"):
        traces.write.mode("overwrite").partitionBy("id").parquet(c.get("sedf-dir"))
    return s.emit("SEDF", traces, "CH")


@command("REMS")
def rems(s: Session, c: Command) -> Session:
    """Accepted and without effect: no computation is defined for it."""
    return s


@command("CTYPES")
def ctypes(s: Session, c: Command) -> Session:
    """Channel types from the label, and rate and Hjorth features beside them."""
    feats = s.rows(c, lambda x, sr: [dict(zip(("H1", "H2", "H3"), dsp.hjorth(x), strict=True))], "H1 double, H2 double, H3 double")
    return s.emit("CTYPES", feats.withColumn("CTYPE", channel_type(F.col("ch"))), "CH")


# ---- epochs and masks ----------------------------------------------------


@command("EPOCH")
def epoch(s: Session, c: Command) -> Session:
    if c.has("clear"):
        return replace(s, epochs=None)
    if c.has("annot"):
        e = ep.epochs_from(s.of_class(c.list("annot")), c.num("w", 0.0), c.num("shift", 0.0), c.num("trunc", 0.0))
    else:
        first = F.lit(0)
        if c.has("align"):
            first = s.of_class(c.list("align")).groupBy("id").agg(F.min("start_ns").alias("o"))
        n = c.num("len", c.num("dur", 30.0))
        grid = s.recordings.select("id", "dur_ns")
        if c.has("align"):
            shifted = grid.join(first, "id").select("id", (F.col("dur_ns") - F.col("o")).alias("dur_ns"), "o")
            e = ep.epochs(shifted, n, c.num("inc")).join(shifted.select("id", "o"), "id").select("id", "e", (F.col("start_ns") + F.col("o")).alias("start_ns"), (F.col("stop_ns") + F.col("o")).alias("stop_ns"), "masked")
        elif s.segments is not None:
            w = Window.partitionBy("id").orderBy("start_ns")
            before = F.sum(F.col("stop_ns") - F.col("start_ns")).over(w) - (F.col("stop_ns") - F.col("start_ns"))
            places = s.segments.select("id", "start_ns", "stop_ns", before.alias("b")).select("id", F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"), "b")
            e = iv.range_join(ep.epochs_in_segments(s.segments, n, c.num("inc")), places, ["id"]).withColumn("pos_ns", F.col("start_ns") - F.col("r_start") + F.col("b")).drop("r_start", "r_stop", "b")
        else:
            e = ep.epochs(grid, n, c.num("inc"), c.num("offset", 0.0))
    s = replace(s, epochs=e)
    s = s.emit("EPOCH", e.groupBy("id").agg(F.count("*").alias("NE"), (F.sum(F.col("stop_ns") - F.col("start_ns")) / NS).alias("TOT_DUR")))
    return s.emit("EPOCH", e, "E") if c.has("dump") or c.has("table") or c.has("verbose") else s


def _ensured(s: Session) -> Session:
    return s if s.epochs is not None else replace(s, epochs=ep.epochs(s.recordings.select("id", "dur_ns"), 30.0))


@command("MASK")
def mask(s: Session, c: Command) -> Session:
    """One option per call."""
    if len(c.params) != 1:
        raise ScriptError("MASK takes exactly one option")
    s = _ensured(s)
    (key, value), e = next(iter(c.params.items())), s.epochs
    mode = ep.MASK if key.startswith("mask-") else ep.UNMASK if key.startswith("unmask-") else ep.FORCE
    bare = key.removeprefix("mask-").removeprefix("unmask-")
    items = (value or "").split(",")

    def spans(word: str) -> tuple[int, int]:
        a, _, b = word.partition("-")
        return int(a), int(b or a)

    def labelled():
        known = s.annots.where(F.col("class").isin(hypno.STAGES))
        return hypno.staged(e, known).withColumnRenamed("stage", "label").drop("conflict")

    base = bare.removesuffix("-any").removesuffix("-all")
    if base in ("if", "ifnot"):
        e = ep.mask_annots(e, s.annots, items, mode, base == "ifnot", bare.endswith("-all"))
    elif bare in ("none", "clear", "include-all"):
        e = ep.mask_all(e, False)
    elif bare in ("all", "total", "exclude-all"):
        e = ep.mask_all(e, True)
    elif bare == "flip":
        e = ep.mask_flip(e)
    elif key == "epoch":
        e = ep.mask_range(e, [spans(x) for x in items])
    elif key == "mask-epoch":
        e = ep.mask_range(e, [spans(x) for x in items], include=False)
    elif key == "sec":
        a, b = (float(x) * NS for x in value.split("-"))
        e = e.withColumn("masked", F.col("masked") | ~((F.col("start_ns") < b) & (F.col("stop_ns") > a)))
    elif key in ("hms", "dhms"):
        at = [F.unix_timestamp(F.lit("1985-01-01 " + x)) for x in value.split("-")]
        start = s.recordings.select("id", F.pmod(F.unix_timestamp("start"), F.lit(86400)).alias("t0"))
        e = e.join(start, "id")
        rel = [F.pmod(F.pmod(x, F.lit(86400)) - F.col("t0"), F.lit(86400)) * NS for x in at]
        e = e.withColumn("masked", F.col("masked") | ~((F.col("start_ns") < rel[1]) & (F.col("stop_ns") > rel[0]))).drop("t0")
    elif key == "first":
        e = ep.mask_first(e, int(value))
    elif key in ("random", "random-from"):
        e = ep.mask_random(e, int(items[-1]))
    elif bare in ("leading", "trailing", "leading-trailing"):
        e = ep.mask_edges(e, int(value), bare != "trailing", bare != "leading")
    elif bare == "interior":
        e = ep.unmask_interior(e)
    elif key == "regional":
        e = ep.mask_regional(e, int(items[0]), int(items[1]))
    elif key == "trim":
        e = ep.mask_trim(labelled(), items[0], int(items[1]) if len(items) > 1 else 0).drop("label")
    elif key == "retain":
        e = ep.mask_annots(e, s.annots, items, ep.FORCE, True)
    elif key == "flanked":
        e = ep.mask_flanked(labelled(), items[0], int(items[1])).drop("label")
    elif key in ("stable-unique", "stable-any"):
        e = ep.mask_stable(labelled(), items[:-1], int(items[-1]), key == "stable-unique").drop("label")
    elif bare in ("expr", "not-expr"):
        notes = s.annots.select("id", F.col("class").alias("_c"), F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
        hits = iv.range_join(e.select("id", "e", "start_ns", "stop_ns"), notes, ["id"]).groupBy("id", "e").agg(F.collect_set("_c").alias("_s"))
        j = e.join(hits, ["id", "e"], "left")
        names = {k: F.coalesce(F.array_contains("_s", k), F.lit(False)) for k in names_in(value)} | {k: F.col(k) for k in ("e", "start_ns", "stop_ns")}
        e = ep.mask_expr(j, compiled(value, names), mode, bare == "not-expr").drop("_s")
    else:
        raise ScriptError(f"MASK doesn't know {key}")
    out = e.groupBy("id").agg(F.count("*").alias("N_TOTAL"), F.sum((~F.col("masked")).cast("long")).alias("N_RETAINED"))
    return replace(s, epochs=e).emit("MASK", out, "EMASK")


@command("RESTRUCTURE", "RE")
def restructure(s: Session, c: Command) -> Session:
    """Drops masked time from traces and epochs; epochs keep their original number and all times restart at 0."""
    s = _ensured(s)
    kept = ep.restructure(s.epochs)
    spans = iv.islands(s.epochs.where("not masked"), ["id"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_ns", "stop_ns"))).alias("spans"))
    cut = lambda r: F.slice("v", (F.round(r["start_ns"] * F.col("sr") / NS) + 1).cast("int"), F.round((r["stop_ns"] - r["start_ns"]) * F.col("sr") / NS).cast("int"))
    samples = s.samples.join(spans, "id").withColumn("v", F.flatten(F.transform("spans", cut)))
    before = s.recordings
    dur = spans.select("id", F.aggregate("spans", F.lit(0).cast("long"), lambda a, r: a + r["stop_ns"] - r["start_ns"]).alias("dur_ns"))
    recordings = before.drop("dur_ns").join(dur, "id").select(*before.columns)
    # a time t moves back by the masked time before it
    gone = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("gone")), lambda a, r: F.struct(r["stop_ns"].alias("at"), F.when(r["start_ns"] <= F.col("t"), a["gone"] + r["start_ns"] - a["at"]).otherwise(a["gone"]).alias("gone")))["gone"]
    moved = kept.join(spans, "id").withColumn("t", F.col("start_ns")).withColumn("_g", gone)
    epochs = moved.withColumns({"start_ns": F.col("start_ns") - F.col("_g"), "stop_ns": F.col("stop_ns") - F.col("_g")}).drop("spans", "t", "_g")
    notes = s.annots.withColumnsRenamed({"start_ns": "a0", "stop_ns": "a1"}).join(spans, "id").withColumn("r", F.explode("spans")).where("a0 < r.stop_ns and (a1 > r.start_ns or a0 = a1 and a0 >= r.start_ns)")
    notes = notes.withColumns({"start_ns": F.greatest("a0", F.col("r.start_ns")), "stop_ns": F.least("a1", F.col("r.stop_ns"))}).withColumn("t", F.col("start_ns")).withColumn("_g", gone)
    annots = notes.withColumns({"start_ns": F.col("start_ns") - F.col("_g"), "stop_ns": F.col("stop_ns") - F.col("_g")}).select(*s.annots.columns)
    out = before.select("id", (F.col("dur_ns") / NS).alias("DUR1"), (F.col("dur_ns") / F.col("rec_ns")).cast("long").alias("NR1")).join(dur, "id", "left").select("id", "NR1", "DUR1", (F.coalesce("dur_ns", F.lit(0)) / NS).alias("DUR2"))
    e = epochs.drop("e_orig") if "e_orig" in s.epochs.columns else epochs
    return replace(s, samples=samples.select(*s.samples.columns), recordings=recordings, epochs=e, annots=annots).emit("RE", out)


@command("DUMP-MASK")
def dump_mask(s: Session, c: Command) -> Session:
    return s.emit("DUMP-MASK", _ensured(s).epochs.select("id", "e", F.col("masked").cast("int").alias("EMASK")), "E")


@command("ANNOT-MASK")
def annot_mask(s: Session, c: Command) -> Session:
    runs = iv.islands(s.epochs.where("not masked" if c.has("inc") else "masked"), ["id"]).select("id", F.lit(".").alias("ch"), (F.col("start_ns") / NS).alias("start"), (F.col("stop_ns") / NS).alias("stop"))
    return s.events(runs, c.get("tag", "E"))


@command("FILE-MASK", "EPOCH-ANNOT")
def file_mask(s: Session, c: Command) -> Session:
    """A text file with a flag or label per epoch, in order."""
    rows = [(i + 1, x.strip()) for i, x in enumerate(open(c.get("include") or c.get("exclude") or c.get("file")))]
    flags = s.spark.createDataFrame(rows, "e long, flag string")
    j = s.epochs.join(F.broadcast(flags), "e", "left")
    if c.name == "EPOCH-ANNOT":
        new = j.where("flag is not null").select("id", F.lit(".").alias("ch"), (F.col("start_ns") / NS).alias("start"), (F.col("stop_ns") / NS).alias("stop"), "flag")
        for label in sorted({x for _, x in rows}):
            s = s.events(new.where(F.col("flag") == label), label)
        return s
    bad = (F.coalesce("flag", F.lit("0")) == "1") if c.has("exclude") else (F.coalesce("flag", F.lit("0")) != "1")
    return replace(s, epochs=j.withColumn("masked", F.col("masked") | bad).drop("flag").select(*s.epochs.columns))


@command("CHEP-MASK")
def chep_mask(s: Session, c: Command) -> Session:
    """Channel x epoch outliers of RMS and Hjorth numbers, iterated over thresholds."""
    e = s.dealt(_ensured(s).epoch_rows(c, lambda x, sr: [dict(zip(("H1", "H2", "H3"), dsp.hjorth(x), strict=True))], "H1 double, H2 double, H3 double"))
    for v in ("H1", "H2", "H3"):
        e = ep.chep_outliers(e, v, [float(x) for x in c.list("ep-th", "3")], [float(x) for x in c.list("ch-th")]).withColumnRenamed("masked", f"_{v}")
    got = e.where("_H1 or _H2 or _H3").select("id", "e", "ch").distinct()
    return replace(s, chep=got if s.chep is None else s.chep.unionByName(got).distinct()).emit("CHEP-MASK", got.groupBy("id", "ch").agg(F.count("*").alias("ANY")), "CH")


@command("CHEP")
def chep(s: Session, c: Command) -> Session:
    if c.has("clear") or s.chep is None:
        return replace(s, chep=None)
    if c.has("epochs"):
        n = s.samples.groupBy("id").agg(F.count("*").alias("_n"))
        bad = s.chep.groupBy("id", "e").agg(F.countDistinct("ch").alias("k")).join(n, "id").where(F.col("k") / F.col("_n") > c.num("epochs", 0.5)).select("id", "e", F.lit(True).alias("_b"))
        s = replace(s, epochs=s.epochs.join(bad, ["id", "e"], "left").withColumn("masked", F.col("masked") | F.coalesce("_b", F.lit(False))).drop("_b"))
    if c.has("channels") or c.has("drop-channels"):
        n = s.epochs.groupBy("id").agg(F.count("*").alias("_n"))
        bad = s.chep.groupBy("id", "ch").agg(F.countDistinct("e").alias("k")).join(n, "id").where(F.col("k") / F.col("_n") > c.num("channels", 0.5)).select("id", "ch")
        s = s.with_samples(s.samples.join(bad, ["id", "ch"], "left_anti"))
    return s.emit("CHEP", s.chep, "CH", "E") if c.has("dump") else s


@command("SEGMENTS", "RECS", "ALIGN-SCAN")
def segments(s: Session, c: Command) -> Session:
    """Contiguous segments (one each of a recording without gaps), records, and how annotations sit on the epoch grid."""
    if c.name == "SEGMENTS" and s.segments is not None:
        seg = s.segments.select("id", F.col("seg").alias("SEG"), (F.col("start_ns") / NS).alias("START"), (F.col("stop_ns") / NS).alias("STOP"), ((F.col("stop_ns") - F.col("start_ns")) / NS).alias("DUR_SEC"))
        gap = F.lead("START").over(Window.partitionBy("id").orderBy("SEG")) - F.col("STOP")
        gaps = seg.select("id", F.col("SEG").alias("GAP"), F.col("STOP").alias("START"), (F.col("STOP") + gap).alias("STOP"), gap.alias("DUR_SEC")).where("DUR_SEC > 0")
        return s.emit("SEGMENTS", seg, "SEG").emit("SEGMENTS", gaps, "GAP")
    if c.name == "SEGMENTS":
        return s.emit("SEGMENTS", s.recordings.select("id", F.lit(1).alias("SEG"), F.lit(0.0).alias("START"), (F.col("dur_ns") / NS).alias("STOP"), (F.col("dur_ns") / NS).alias("DUR_SEC")), "SEG")
    if c.name == "RECS":
        r = s.recordings.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("dur_ns") / F.col("rec_ns")))).alias("REC"), "rec_ns")
        return s.emit("RECS", r.select("id", "REC", ((F.col("REC") - 1) * F.col("rec_ns")).alias("start_ns"), (F.col("REC") * F.col("rec_ns")).alias("stop_ns")), "REC")
    e = _ensured(s).epochs.groupBy("id").agg(F.min("start_ns").alias("o"), F.min(F.col("stop_ns") - F.col("start_ns")).alias("n"))
    a = s.annots.join(e, "id").withColumn("off", F.pmod(F.col("start_ns") - F.col("o"), F.col("n")) != 0)
    return s.emit("ALIGN-SCAN", a.groupBy("id", "class").agg(F.count("*").alias("ANN_N"), F.sum((~F.col("off")).cast("int")).alias("ANN_AT_EPOCH"), F.sum(F.col("off").cast("int")).alias("ANN_OFF_EPOCH")), "ANNOT")


@command("SLICE")
def slices(s: Session, c: Command) -> Session:
    """Traces within annotations: id, class, start_ns, ch, v, and the spectrum's total power."""
    flat = iv.islands(s.of_class(c.list("annot")), ["id", "class"])
    j = s.channels(c).join(flat, "id").select("id", "ch", "class", "start_ns", "sr", F.slice("v", (F.round(F.col("start_ns") * F.col("sr") / NS) + 1).cast("int"), F.round((F.col("stop_ns") - F.col("start_ns")) * F.col("sr") / NS).cast("int")).alias("v"))
    return s.emit("SLICE", j, "CH", "ANNOT")


# ---- annotations ---------------------------------------------------------


def _interval_class(s: Session, df, name: str) -> Session:
    rows = df.select("id", F.lit(".").alias("ch"), (F.col("start_ns") / NS).alias("start"), (F.col("stop_ns") / NS).alias("stop"))
    return s.events(rows, name)


@command("ANNOTS", "DUMP-EPOCHS")
def annots(s: Session, c: Command) -> Session:
    a = s.of_class(c.list("annot") or ["*"])
    s = s.emit("ANNOTS", a.groupBy("id", "class").agg(F.count("*").alias("COUNT"), (F.sum(F.col("stop_ns") - F.col("start_ns")) / NS).alias("DUR")), "ANNOT")
    s = s.emit("ANNOTS", a.select("id", "class", "inst", "ch", (F.col("start_ns") / NS).alias("START"), (F.col("stop_ns") / NS).alias("STOP")), "ANNOT", "INST")
    if c.has("epoch") or c.name == "DUMP-EPOCHS":
        n = a.select("id", "class", F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
        s = s.emit("ANNOTS", iv.range_join(_ensured(s).epochs.select("id", "e", "masked", "start_ns", "stop_ns"), n, ["id"]).select("id", "e", "class", "masked"), "E", "ANNOT")
    return s


@command("ESPAN")
def espan(s: Session, c: Command) -> Session:
    out = iv.coverage(_ensured(s).epochs.select("id", "e", "start_ns", "stop_ns"), s.of_class(c.list("annot")), ["id"])
    return s.emit("ESPAN", out.select("id", "e", F.col("sec").alias("SEC"), F.col("pct").alias("PCT"), F.col("cnt").alias("CNT"), F.col("has").alias("HAS")), "E")


@command("SPANNING")
def spanning(s: Session, c: Command) -> Session:
    flat = iv.islands(s.of_class(c.list("annot") or ["*"]), ["id"]).groupBy("id").agg((F.sum(F.col("stop_ns") - F.col("start_ns")) / NS).alias("SPANNED_SEC"), F.count("*").alias("NSEGS"))
    j = s.recordings.join(flat, "id", "left").withColumn("REC_SEC", F.col("dur_ns") / NS)
    return s.emit("SPANNING", j.select("id", "REC_SEC", F.coalesce("SPANNED_SEC", F.lit(0.0)).alias("SPANNED_SEC"), F.coalesce(F.col("SPANNED_SEC") / F.col("REC_SEC") * 100, F.lit(0.0)).alias("SPANNED_PCT"), F.coalesce("NSEGS", F.lit(0)).alias("NSEGS")))


@command("MAKE-ANNOTS")
def make_annots(s: Session, c: Command) -> Session:
    """``annot=new expr=A|B``, ``A*B``, ``A+B`` (A that overlaps B), ``A-B`` (A that doesn't); or flatten, complement, pool, midpoint/start/stop of a class."""
    import re

    new = c.get("annot", "new")
    if c.has("expr"):
        a, op, b = re.fullmatch(r"(\w+)\s*([|*+-])\s*(\w+)", c.get("expr").replace("OR", "|")).groups()
        x, y = (s.annots.where(F.col("class") == n).select("id", "start_ns", "stop_ns") for n in (a, b))
        other = y.withColumnsRenamed({"start_ns": "r_start", "stop_ns": "r_stop"})
        got = {"|": lambda: iv.union(x, y, ["id"]), "*": lambda: iv.intersection(x, y, ["id"]), "+": lambda: iv.range_join(x, other, ["id"], how="left_semi"), "-": lambda: iv.range_join(x, other, ["id"], how="left_anti")}[op]()
        return _interval_class(s, got, new)
    for key in ("flatten", "pool", "pool-flatten"):
        if c.has(key):
            return _interval_class(s, iv.islands(s.of_class(c.list(key)), ["id"]), new)
    if c.has("complement"):
        bounds = s.recordings.select("id", F.lit(0).cast("long").alias("lo"), F.col("dur_ns").alias("hi"))
        return _interval_class(s, iv.complement(s.of_class(c.list("complement")), ["id"], bounds), new)
    if c.has("excise"):
        a, b = c.list("excise")
        return _interval_class(s, iv.excise(s.of_class([a]), s.of_class([b]), ["id"]), new)
    for key in ("midpoint", "start", "stop"):
        if c.has(key):
            return _interval_class(s, iv.reduce_to(s.of_class(c.list(key)), key), new)
    if c.has("epoch"):
        return _interval_class(s, _ensured(s).epochs.where("not masked"), new)
    raise ScriptError("MAKE-ANNOTS needs an operation")


@command("EXTEND")
def extend(s: Session, c: Command) -> Session:
    w = round(c.num("w", 0.0) * NS)
    hit = s.in_class(c.list("annots"))
    return replace(s, annots=iv.extend(s.annots.where(hit), w, w).unionByName(s.annots.where(~hit)))


@command("META")
def meta(s: Session, c: Command) -> Session:
    """Adds metadata ``md`` to a class: count, overlap seconds or signed distance to the nearest of another class."""
    a, key = s.of_class(c.list("annot")), c.get("md", "md")
    rest = s.annots.join(a.select("class").distinct(), "class", "left_anti").select(*s.annots.columns)
    cols = ["id", "class", "inst", "ch", "start_ns", "stop_ns"]
    if c.has("nearest"):
        o = iv.reduce_to(s.of_class(c.list("other")), "start").select("id", F.col("start_ns").alias("t_ns"))
        v = iv.nearest(a.select(*cols, F.col("start_ns").alias("t_ns")), o, ["id"]).select(*cols, F.col("nearest_s").alias("_v"))
    else:
        v = iv.coverage(a.select(*cols), s.of_class(c.list("other")), ["id"]).select(*cols, F.col("cnt" if c.has("count") else "sec").alias("_v"))
    new = a.join(v, cols).withColumn("meta", F.map_concat("meta", F.create_map(F.lit(key), F.col("_v").cast("string")))).select(*s.annots.columns)
    return replace(s, annots=rest.unionByName(new))


@command("AXA")
def axa(s: Session, c: Command) -> Session:
    a = s.of_class(c.list("annot") or ["*"]).select("id", "class", "start_ns", "stop_ns")
    return s.emit("AXA", iv.axa(a, a, ["id"]), "SEED", "ANNOT")


@command("OVERLAP")
def overlap(s: Session, c: Command) -> Session:
    """Seeds that overlap others, against a null of circular shifts: OBS, EXP, Z, P.

    A recording's seeds and its merged others meet in one row; each replicate moves
    all seeds by one offset around the recording, and a seed that crosses its end
    goes on at its start.  A task adds up its recordings' counts by replicate, and
    Spark those of the tasks.
    """
    reps, seed = int(c.num("nreps", 1000)), int(s.variables.get("srand", "1"))
    pack = lambda: F.collect_list(F.struct("start_ns", "stop_ns"))
    seeds = s.of_class(c.list("seed")).groupBy("id", F.col("class").alias("seed")).agg(pack().alias("a"))
    other = iv.islands(s.of_class(c.list("other")), ["id"]).groupBy("id").agg(pack().alias("b"))
    j = seeds.join(s.recordings.select("id", "dur_ns"), "id").join(other, "id", "left").select("id", "seed", "dur_ns", "a", "b")

    def run(parts):
        sums: dict[str, np.ndarray] = {}
        for p in parts:
            for i, name, dur, a, b in p.itertuples(index=False):
                x = np.array([(r["start_ns"], r["stop_ns"]) for r in a], np.int64)
                y = np.array(sorted((r["start_ns"], r["stop_ns"]) for r in b) if b is not None else [], np.int64).reshape(-1, 2)
                by = np.random.default_rng([seed, zlib.crc32(str(i).encode())]).integers(0, max(dur, 1), reps)
                n = sums.setdefault(name, np.zeros(reps + 1, np.int64))
                n[0] += _meets(x[:, 0], x[:, 1], y).sum()
                step = max(1, 100_000 // len(x))  # replicates side by side
                for k in range(0, reps, step):
                    at = (x[None, :, 0] + by[k : k + step, None]) % max(dur, 1)
                    end = at + (x[:, 1] - x[:, 0])[None, :]
                    hit = _meets(at.ravel(), end.ravel(), y) | (_meets(np.zeros(at.size, np.int64), (end - dur).ravel(), y) & (end > dur).ravel())
                    n[k + 1 : k + 1 + len(at)] += hit.reshape(at.shape).sum(1)
        for name, n in sums.items():
            yield pd.DataFrame({"seed": name, "rep": np.arange(reps + 1, dtype=np.int32), "n": n})

    dealt = j.repartition(max(1, int(s.spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    grid = dealt.mapInPandas(run, "seed string, rep int, n long").groupBy("seed", "rep").agg(F.sum("n").alias("n"))
    obs = grid.where("rep = 0").select("seed", F.col("n").alias("OBS"))
    null = grid.where("rep > 0").join(obs, "seed").groupBy("seed", "OBS").agg(F.avg("n").alias("EXP"), F.stddev_pop("n").alias("sd"), F.sum((F.col("n") >= F.col("OBS")).cast("int")).alias("ge"))
    out = null.select("seed", "OBS", "EXP", F.when(F.col("sd") > 0, (F.col("OBS") - F.col("EXP")) / F.col("sd")).alias("Z"), ((F.col("ge") + 1) / F.lit(reps + 1)).alias("P"))
    return s.emit("OVERLAP", out, "SEED")


def _meets(start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each interval (a point: its start) meets one of the ascending, disjoint ``other``."""
    if not len(other):
        return np.zeros(len(start), bool)
    last = np.maximum(stop, start + 1)
    k = np.searchsorted(other[:, 0], last, "left") - 1
    return (k >= 0) & (other[np.maximum(k, 0), 1] > start)


@command("A2S")
def a2s(s: Session, c: Command) -> Session:
    """0/1 channel of a class at a rate, from its flattened intervals."""
    sr, label = c.num("sr"), c.get("label", c.get("annot"))
    spans = iv.islands(s.of_class(c.list("annot")), ["id"]).groupBy("id").agg(F.collect_list(F.struct("start_ns", "stop_ns")).alias("g"))
    base = s.recordings.join(spans, "id", "left").select("id", "dur_ns", "g")

    def run(parts):
        for p in parts:
            rows = []
            for i, dur, g in p.itertuples(index=False):
                x = np.zeros(round(dur / NS * sr))
                for r in g if g is not None else []:
                    x[round(r["start_ns"] * sr / NS) : round(r["stop_ns"] * sr / NS)] = 1
                rows.append((i, label, sr, "", x))
            yield pd.DataFrame(rows, columns=["id", "ch", "sr", "unit", "v"])

    return s.with_samples(s.samples.unionByName(base.mapInPandas(run, s.samples.schema)))


@command("S2A")
def s2a(s: Session, c: Command) -> Session:
    """Runs of values in ranges ``encoding=label,lo,hi,...`` become annotations."""
    enc = c.list("encoding")
    for label, lo, hi in zip(enc[::3], enc[1::3], enc[2::3], strict=True):
        rows = s.rows(c, lambda x, sr, lo=float(lo), hi=float(hi): [{"start": a / sr, "stop": b / sr} for a, b in dsp.runs((x >= lo) & (x <= hi))], "start double, stop double")
        s = s.events(rows, label)
    return s


@command("S2C")
def s2c(s: Session, c: Command) -> Session:
    """Cycles between upward zero crossings: start, stop, amplitude, time of the trough and peak."""

    def one(x, sr):
        up = np.flatnonzero((x[:-1] <= 0) & (x[1:] > 0)) + 1
        return [{"START": a / sr, "STOP": b / sr, "AMP": float(np.ptp(x[a:b])), "T_PEAK": (a + int(x[a:b].argmax())) / sr, "T_TROUGH": (a + int(x[a:b].argmin())) / sr} for a, b in zip(up[:-1], up[1:], strict=True)]

    return s.emit("S2C", s.rows(c, one, "START double, STOP double, AMP double, T_PEAK double, T_TROUGH double"), "CH", "N")


@command("MEANS")
def means(s: Session, c: Command) -> Session:
    """Mean of signals within each class (flattened), and by minimum-maximum normalised values."""
    spans = iv.islands(s.of_class(c.list("annot")), ["id", "class"])
    part = F.slice("v", (F.floor(F.col("start_ns") * F.col("sr") / NS) + 1).cast("int"), F.greatest(F.lit(0), F.round((F.col("stop_ns") - F.col("start_ns")) * F.col("sr") / NS)).cast("int"))
    j = s.channels(c).join(spans, "id").select("id", "ch", "class", part.alias("p"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    total, n = F.sum(F.aggregate("p", F.lit(0.0), lambda a, x: a + x)), F.sum(F.size("p"))
    m = j.groupBy("id", "ch", "class", "lo", "hi").agg(F.try_divide(total, n).alias("M"), n.alias("S"))
    return s.emit("MEANS", m.select("id", "ch", "class", "M", "S", F.try_divide(F.col("M") - F.col("lo"), F.col("hi") - F.col("lo")).alias("M1")), "CH", "ANNOT")


@command("TABULATE")
def tabulate(s: Session, c: Command) -> Session:
    x = s.channels(c).select("id", "ch", F.explode("v").alias("x"))
    v = F.floor(F.col("x") / c.num("bin")) * c.num("bin") if c.has("bin") else F.round("x", int(c.num("prec", 6)))
    return s.emit("TABULATE", x.groupBy("id", "ch", v.alias("VALUE")).agg(F.count("*").alias("N")).where(F.col("N") >= int(c.num("req", 0))), "CH", "VALUE")


@command("EVAL")
def evaluate(s: Session, c: Command) -> Session:
    """Per epoch: an expression over the counts and seconds of each class (``N2.n``, ``N2.sec``, ``N2`` = present); true epochs become annotations."""
    e = _ensured(s).epochs.where("not masked").select("id", "e", "start_ns", "stop_ns")
    classes = sorted({n.removesuffix(".sec").removesuffix(".n") for n in names_in(c.get("expr"))} - {"e", "start_ns", "stop_ns"})
    names: dict = {k: F.col(k) for k in ("e", "start_ns", "stop_ns")}
    a = s.annots.select("id", F.col("class").alias("_c"), F.col("start_ns").alias("r_start"), F.col("stop_ns").alias("r_stop"))
    hits = iv.range_join(e, a.where(F.col("_c").isin(classes)), ["id"]).groupBy("id", "e").agg(F.lit(True).alias("_any"), *(x for k in classes for x in (F.sum(F.when(F.col("_c") == k, 1).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(F.col("_c") == k, (F.least("stop_ns", "r_stop") - F.greatest("start_ns", "r_start")) / NS).otherwise(0.0)).alias(f"s_{k}"))))
    j = e.join(hits, ["id", "e"], "left")
    for k in classes:
        n, sec = F.coalesce(F.col(f"`n_{k}`"), F.lit(0)), F.coalesce(F.col(f"`s_{k}`"), F.lit(0.0))
        names |= {k: n > 0, f"{k}.n": n, f"{k}.sec": sec}
    out = j.select("id", "e", "start_ns", "stop_ns", compiled(c.get("expr"), names).alias("VALUE"))
    s = s.emit("EVAL", out.select("id", "e", "VALUE"), "E")
    if c.has("annot") and dict(out.dtypes)["VALUE"] == "boolean":
        s = _interval_class(s, out.where("VALUE"), c.get("annot"))
    return s


@command("DERIVE")
def derive(s: Session, c: Command) -> Session:
    """One expression per recording over vectors of each class's seconds."""
    classes = names_in(c.get("expr"))
    g = s.annots.groupBy("id").agg(*(F.collect_list(F.when(F.col("class") == k, (F.col("stop_ns") - F.col("start_ns")) / NS)).alias(k) for k in classes))
    return s.emit("DERIVE", g.select("id", compiled(c.get("expr"), classes).cast("string").alias(c.get("var", "VALUE"))))


@command("TRANS")
def trans(s: Session, c: Command) -> Session:
    """``sig=new expr="a = C3 * 2 ; a - C4"``: sample-wise over channels of one rate, in Catalyst expressions."""
    used = names_in(c.get("expr"))
    wide = s.samples.where(F.col("ch").isin(used)).groupBy("id", "sr", "unit").pivot("ch", used).agg(F.first("v"))
    wide = wide.where(" and ".join(f"`{u}` is not null" for u in used))
    rows = F.arrays_zip(*(F.col(f"`{u}`") for u in used))
    name = c.get("sig") or last_name(c.get("expr"))
    fn = lambda r: assignments_on(c.get("expr"), {u: r[u] for u in used})
    out = wide.select("id", F.lit(name).alias("ch"), "sr", "unit", F.transform(rows, fn).cast("array<double>").alias("v"))
    if c.has("annot"):
        flagged = replace(s, samples=out).rows(Command("S2A", {"sig": "*"}), lambda x, sr: [{"start": a / sr, "stop": b / sr} for a, b in dsp.runs(x > 0)], "start double, stop double")
        return s.events(flagged, c.get("annot"))
    return s.with_samples(s.samples.where(F.col("ch") != name).unionByName(out))


def last_name(text: str) -> str:
    """The name that the last of a row's assignments gives."""
    import re

    m = re.match(r"\s*([A-Za-z_][\w.]*)\s*=(?![=~])", text.split(";")[-1])
    return m[1] if m else "_value"


def assignments_on(text: str, names: dict):
    """Value of the last of a row's assignments."""
    import re

    have, value = dict(names), None
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.match(r"([A-Za-z_][\w.]*)\s*=(?![=~])(.*)", part, re.S)
        name, body = (m[1], m[2]) if m else ("_value", part)
        have[name] = value = compiled(body, have)
    return value


# ---- staging -------------------------------------------------------------


@command("STAGE")
def stage(s: Session, c: Command) -> Session:
    h = hypno.staged(_ensured(s).epochs, s.annots)
    return s.emit("STAGE", h.select("id", "e", F.col("stage").alias("STAGE"), F.col("conflict").alias("CONFLICT")), "E")


@command("HYPNO")
def hypnogram(s: Session, c: Command) -> Session:
    h = hypno.staged(_ensured(s).epochs.where("not masked"), s.annots).select("id", "e", "stage")
    s = s.emit("HYPNO", hypno.summary(h))
    per = h.groupBy("id", "stage").agg((F.count("*") * 0.5).alias("MINS"))
    s = s.emit("HYPNO", per.withColumn("PCT", F.col("MINS") / F.sum("MINS").over(Window.partitionBy("id"))), "SS")
    s = s.emit("HYPNO", hypno.bout_summary(h, ["id"]), "BOUT")
    s = s.emit("HYPNO", hypno.transitions(h, ["id"]), "PRE", "POST")
    s = s.emit("HYPNO", hypno.flanking(h, ["id"]), "E")
    return s.emit("HYPNO", hypno.cycles(h).where("cycle > 0").groupBy("id", "cycle").agg((F.count("*") * 0.5).alias("MINS"), F.min("e").alias("START")), "C")


@command("EVAL-STAGES")
def eval_stages(s: Session, c: Command) -> Session:
    """Agreement of the staging with labels in a file, one per epoch."""
    from hypnoframe.functions.stats import kappa

    h = hypno.staged(_ensured(s).epochs, s.annots).select("id", "e", "stage")
    other = s.spark.createDataFrame([(i + 1, x.strip()) for i, x in enumerate(open(c.get("file")))], "e long, other string")
    return s.emit("EVAL-STAGES", kappa(h.join(F.broadcast(other), "e"), "stage", "other"))


@command("DAYS")
def days(s: Session, c: Command) -> Session:
    """Noon-to-noon (or ``anchor``-hour) days of each recording, as annotations and a table."""
    anchor = int(c.num("anchor", 12))
    t0 = F.unix_timestamp("start")
    r = s.recordings.select("id", t0.alias("t0"), (F.col("dur_ns") / NS).alias("dur"))
    first = F.floor((F.col("t0") - anchor * 3600) / 86400)
    last = F.floor((F.col("t0") + F.col("dur") - 1 - anchor * 3600) / 86400)
    d = r.select("id", "t0", "dur", first.alias("f"), F.explode(F.sequence(first, last)).alias("k"))
    d = d.select("id", (F.col("k") - F.col("f") + 1).alias("DAY"), F.greatest(F.lit(0.0), F.col("k") * 86400 + anchor * 3600 - F.col("t0")).cast("double").alias("START_SEC"), F.least("dur", (F.col("k") + 1) * 86400 + anchor * 3600 - F.col("t0")).alias("STOP_SEC"), F.dayofweek(F.to_date(F.from_unixtime(F.col("k") * 86400 + anchor * 3600))).isin(1, 7).cast("int").alias("WEEKEND"))
    s = s.emit("DAYS", d, "DAY")
    return s.events(d.select("id", F.lit(".").alias("ch"), F.col("START_SEC").alias("start"), F.col("STOP_SEC").alias("stop")), c.get("prefix", "day"))


@command("ACTIG")
def actigraphy(s: Session, c: Command) -> Session:
    """Non-parametric rest-activity numbers (IS, IV, L5, M10, RA) and sleep by a threshold on smoothed activity, per channel."""
    per = int(c.num("bin", 60))  # minutes

    def one(x, sr):
        n = round(sr * 60 * per)
        h = x[: len(x) // n * n].reshape(-1, n).mean(1) if len(x) >= n else np.array([])
        day = 1440 // per
        if len(h) < day:
            return []
        var = ((h - h.mean()) ** 2).mean()
        prof = np.array([h[k::day].mean() for k in range(day)])
        ring = np.concatenate([prof, prof])
        win = lambda hours: np.array([ring[k : k + max(1, round(hours * 60 / per))].mean() for k in range(day)])
        l5, m10 = win(5), win(10)
        low = dsp.moving_average(h, 5) < 0.4 * h.mean() if len(h) >= 5 else h < 0.4 * h.mean()
        return [{"NP_IS": float(((prof - h.mean()) ** 2).mean() / var) if var else 0.0, "NP_IV": float((np.diff(h) ** 2).mean() / var) if var else 0.0, "NP_L5": float(l5.min()), "NP_M10": float(m10.max()), "NP_RA": float((m10.max() - l5.min()) / (m10.max() + l5.min())) if m10.max() + l5.min() else 0.0, "NP_L5_ONSET_MIN": float(l5.round(9).argmin() * per), "NP_M10_ONSET_MIN": float(m10.round(9).argmax() * per), "SCORE_TST": float(low.sum() * per), "SCORE_TWT": float((~low).sum() * per)}]

    return s.emit("ACTIG", s.rows(c, one, ", ".join(f"{k} double" for k in ("NP_IS", "NP_IV", "NP_L5", "NP_M10", "NP_RA", "NP_L5_ONSET_MIN", "NP_M10_ONSET_MIN", "SCORE_TST", "SCORE_TWT"))), "CH")


@command("PREDICT")
def predict(s: Session, c: Command) -> Session:
    """Linear prediction from a cached feature table (id, var, value) and a coefficient file (var mean sd b)."""
    model = s.spark.read.csv(c.get("model"), sep="\t", header=True, inferSchema=True)
    j = s.caches[c.get("cache", "cache")].join(F.broadcast(model), "var").groupBy("id").agg(F.sum((F.col("value") - F.col("mean")) / F.col("sd") * F.col("b")).alias("Y"), F.count("*").alias("NF_OBS"))
    return s.emit("PREDICT", j)


@command("DYNAM")
def dynam(s: Session, c: Command) -> Session:
    from hypnoframe.operators.rolling import quantile_dynamics

    d = s.caches[c.get("cache", "cache")]
    return s.emit("DYNAM", quantile_dynamics(d, ["id", "var"], ["e"], "value", int(c.num("dynam-nq", 10))), "VAR", "Q")


# ---- time lines with gaps --------------------------------------------------


@command("ALIASES")
def show_aliases(s: Session, c: Command) -> Session:
    rows = [(kind, name, alias) for kind, m in s.aliases.items() for alias, name in m.items()]
    return s.emit("ALIASES", s.spark.createDataFrame(rows, "KIND string, NAME string, ORIG string"), "KIND", "NAME")


@command("SET-TIMESTAMPS")
def set_timestamps(s: Session, c: Command) -> Session:
    """Start times (seconds, a line for each record, in order) from ``file``: records that don't follow one another part the recording."""
    lines = s.spark.read.text(c.get("file"), wholetext=True).select(F.posexplode(F.filter(F.split("value", "\\s+"), lambda x: F.length(x) > 0)).alias("r", "t"))
    rec = s.recordings.select("id", "rec_ns", F.floor(F.col("dur_ns") / F.col("rec_ns")).alias("nr"))
    at = rec.join(lines, F.col("r") < F.col("nr")).select("id", "rec_ns", "nr", "r", F.round(F.col("t").cast("double") * NS).cast("long").alias("start_ns"))
    short = at.groupBy("id", "nr").agg(F.count("*").alias("n")).where("n < nr").limit(1).count()
    w = Window.partitionBy("id").orderBy("r")
    new = F.when(F.lag("start_ns").over(w).isNull() | (F.lag("start_ns").over(w) + F.col("rec_ns") != F.col("start_ns")), 1).otherwise(0)
    if short or at.where("start_ns is null").limit(1).count() or at.withColumn("back", F.col("start_ns") < F.lag("start_ns").over(w) + F.col("rec_ns")).where("back").limit(1).count():
        raise ScriptError("SET-TIMESTAMPS: a time for each record is needed, in ascending order without overlap")
    segs = at.withColumn("n", new).withColumn("seg", F.sum("n").over(w)).groupBy("id", "seg").agg(F.min("start_ns").alias("start_ns"), F.max(F.col("start_ns") + F.col("rec_ns")).alias("stop_ns"))
    return replace(s, segments=segs, epochs=None)


@command("EDF-", "EDF-MINUS")
def without_gaps(s: Session, c: Command) -> Session:
    """A recording with gaps becomes one without: zeros stand in the gaps (``policy=zero``), or segments are joined (``policy=splice``)."""
    if s.segments is None:
        return s
    w = Window.partitionBy("id").orderBy("start_ns")
    dur = F.col("stop_ns") - F.col("start_ns")
    places = s.segments.select("id", "start_ns", "stop_ns", (F.sum(dur).over(w) - dur).alias("b"), F.coalesce(F.col("start_ns") - F.lag("stop_ns").over(w), F.col("start_ns")).alias("gap"))
    packed = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_ns", "stop_ns", "b", "gap"))).alias("g"), F.max("stop_ns").alias("end"), F.sum("gap").alias("lost"))
    n = lambda x: F.round(x * F.col("sr") / NS).cast("int")
    piece = lambda r: F.slice("v", n(r["b"]) + 1, n(r["stop_ns"] - r["start_ns"]))
    splice = c.get("policy", "zero") == "splice"
    filled = F.flatten(F.transform("g", (lambda r: piece(r)) if splice else (lambda r: F.concat(F.array_repeat(F.lit(0.0), n(r["gap"])), piece(r)))))
    samples = s.samples.join(packed, "id").withColumn("v", filled).select(*s.samples.columns)
    recs = s.recordings.join(packed, "id").withColumn("dur_ns", F.col("end") - F.col("lost") if splice else F.col("end")).select(*s.recordings.columns)
    out = s.recordings.join(packed, "id").select("id", (F.col("dur_ns") / NS).alias("DUR_ORIG"), ((F.col("end") - F.col("lost") if splice else F.col("end")) / NS).alias("DUR_EDIT"), F.size("g").alias("N_ALL"))
    return replace(s, samples=samples, recordings=recs, segments=None, epochs=None).emit(c.name, out)


@command("ALIGN")
def align(s: Session, c: Command) -> Session:
    """Keeps what annotations of ``align`` cover, in whole records counted from each annotation's start."""
    rec = s.recordings.select("id", "rec_ns", "dur_ns")
    spans = iv.islands(s.of_class(c.list("align")), ["id"]).join(rec, "id").withColumn("stop_ns", F.least("stop_ns", "dur_ns"))
    whole = spans.withColumn("stop_ns", F.col("start_ns") + F.floor((F.col("stop_ns") - F.col("start_ns")) / F.col("rec_ns")) * F.col("rec_ns")).where("stop_ns > start_ns")
    e = whole.withColumn("e", F.row_number().over(Window.partitionBy("id").orderBy("start_ns")).cast("long")).select("id", "e", "start_ns", F.col("stop_ns").cast("long").alias("stop_ns"), F.lit(False).alias("masked"))
    return replace(restructure(replace(s, epochs=e), c), epochs=None)


#: commands that are refused: they have no meaning of their own
NOT_BUILT = {"EPOCH-MASK": "redundant: use MASK"}


def _refuse(name: str, why: str) -> None:
    @command(name)
    def run(s: Session, c: Command) -> Session:
        raise ScriptError(f"{name}: {why}")


for _name, _why in NOT_BUILT.items():
    _refuse(_name, _why)
