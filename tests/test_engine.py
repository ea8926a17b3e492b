import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hypnoframe.functions import dsp
from hypnoframe.functions.expr import ExpressionError, compiled
from hypnoframe.operators import epochs as ep
from hypnoframe.operators import intervals as iv
from hypnoframe.plans import procs
from hypnoframe.plans.script import ScriptError, parse
from hypnoframe.plans.session import COMMANDS, Session
from hypnoframe.sources import annotfile, edf

SR, NE = 64.0, 20


@pytest.fixture(scope="module")
def session(spark):
    r = np.random.default_rng(42)
    x = dsp.sine(SR, 30 * NE, 10, 20)
    stages = ["W"] * 4 + ["N1"] * 2 + ["N2"] * 8 + ["R"] * 4 + ["W"] * 2
    return Session.create(spark, {"T1": {"EEG": (SR, x), "EMG": (SR, r.normal(size=len(x)))}}, [("T1", s, 30 * i, 30 * (i + 1)) for i, s in enumerate(stages)])


def one(df):
    return df.collect()[0]


# ---- interval algebra against brute force --------------------------------


def rows(spark, xs):
    return spark.createDataFrame([(1, int(a), int(b)) for a, b in xs], "id long, start_ns long, stop_ns long")


def times(xs):
    return {t for a, b in xs for t in range(a, b)}


def test_interval_algebra(spark):
    r = random.Random(4)
    for _ in range(3):
        a, b = ([(s, s + r.randint(1, 9)) for s in (r.randrange(60) for _ in range(9))] for _ in range(2))
        da, db = rows(spark, a), rows(spark, b)
        got = lambda d: {t for x in d.collect() for t in range(x["start_ns"], x["stop_ns"])}
        assert got(iv.islands(da, ["id"])) == times(a)
        assert got(iv.union(da, db, ["id"])) == times(a) | times(b)
        assert got(iv.intersection(da, db, ["id"], 7)) == times(a) & times(b)
        assert got(iv.excise(da, db, ["id"])) == times(a) - times(b)
        bounds = spark.createDataFrame([(1, 0, 80)], "id long, lo long, hi long")
        assert got(iv.complement(da, ["id"], bounds)) == set(range(80)) - times(a)
        other = db.withColumnsRenamed({"start_ns": "r_start", "stop_ns": "r_stop"})
        pairs = sorted((x["start_ns"], x["stop_ns"], x["r_start"], x["r_stop"]) for x in iv.range_join(da, other, ["id"], 7).collect())
        assert pairs == sorted((*x, *y) for x in a for y in b if x[0] < y[1] and x[1] > y[0])
        keep = {(x["start_ns"], x["stop_ns"]) for x in iv.range_join(da, other, ["id"], 7, "left_semi").collect()}
        assert keep == {x for x in a if any(x[0] < y[1] and x[1] > y[0] for y in b)}


def test_points(spark):
    w = rows(spark, [(10, 20)])
    p = spark.createDataFrame([(1, t, t) for t in (9, 10, 19, 20)], "id long, r_start long, r_stop long")
    assert sorted(x["r_start"] for x in iv.range_join(w, p, ["id"], 7).collect()) == [10, 19]
    assert one(spark.range(1).select(iv.overlaps(F.lit(5), F.lit(5), F.lit(5), F.lit(5)).alias("x")))["x"]


# ---- masks ----------------------------------------------------------------


def test_mask_truth_table(spark):
    t = spark.createDataFrame([(m, x) for m in (False, True) for x in (False, True)], "m boolean, x boolean")
    for mode in (0, 1, 2):
        for negate in (False, True):
            got = {(r["m"], r["x"]): r["y"] for r in t.withColumn("y", ep.updated(F.col("m"), F.col("x"), mode, negate)).collect()}
            for (m, x), y in got.items():
                b = (x if mode in (0, 2) else not x) if not negate else (not x if mode in (0, 2) else x)
                want = b if mode == 2 else (m or b) if mode == 0 else (m and b)
                assert y == want, (mode, negate, m, x)


@pytest.mark.parametrize("n,inc", [(30, None), (30, 15), (5, None), (7, 3)])
def test_epoch_grid(spark, n, inc):
    d = spark.createDataFrame([("a", 600 * iv.SECOND)], "id string, dur_ns long")
    assert ep.epochs(d, n, inc).count() == (600 - n) // (inc or n) + 1


def test_spliced_epochs(spark):
    segs = spark.createDataFrame([("a", 0, 50), ("a", 80, 150)], "id string, start_ns long, stop_ns long").withColumns({c: F.col(c) * iv.SECOND for c in ("start_ns", "stop_ns")})
    got = [(x["start_ns"] // iv.SECOND, x["stop_ns"] // iv.SECOND) for x in ep.epochs_spliced(segs, 30).orderBy("e").collect()]
    assert got == [(0, 30), (30, 90), (90, 120), (120, 150)]


def test_masks_and_restructure(session):
    kept = lambda script: one(session.eval(script).table("MASK", "EMASK"))["N_RETAINED"]
    assert kept("EPOCH & MASK all") == 0 and kept("EPOCH & MASK none") == NE
    assert kept("EPOCH & MASK ifnot=N2") == 8 and kept("EPOCH & MASK if=N2") == 12
    assert kept("EPOCH & MASK epoch=1-10") == 10 and kept("EPOCH & MASK first=3") == 3
    assert kept("EPOCH & MASK trim=W,1") == 16 and kept("EPOCH & MASK flanked=N2,1") == 6
    assert kept('EPOCH & MASK expr="N2 || R"') == 8
    s = session.eval("EPOCH & MASK ifnot=N2 & RE & STATS sig=EEG & HYPNO")
    r = one(s.table("STATS", "CH"))
    assert r["N"] == 8 * 30 * SR and r["SD"] == pytest.approx(20 / math.sqrt(2), abs=0.05)
    assert one(s.table("HYPNO"))["TST"] == 4.0 and one(s.table("RE"))["DUR2"] == 240


def test_hypnogram(session):
    h = one(session.eval("EPOCH & HYPNO").table("HYPNO"))
    assert (h["TIB"], h["TST"], h["SOL"], h["FWT"], h["WASO"]) == (10.0, 7.0, 2.0, 1.0, 0.0)
    assert h["SE"] == 70.0 and h["REM_LAT"] == 5.0 and h["TWT"] == h["SOL"] + h["WASO"] + h["FWT"]


# ---- signals --------------------------------------------------------------


def test_psd_peak_and_filters(session):
    spec = session.eval("PSD spectrum sig=EEG").table("PSD", "CH", "F").collect()
    assert max(spec, key=lambda r: r["PSD"])["F"] == pytest.approx(10, abs=1)
    rms = lambda script: one(session.eval(script + " & STATS sig=EEG").table("STATS", "CH"))["RMS"]
    full = rms("READ")
    assert rms("FILTER sig=EEG lowpass=5 tw=1") < 0.05 * full and rms("FILTER sig=EEG highpass=15 tw=1") < 0.05 * full
    assert rms("FILTER sig=EEG bandpass=8,12 tw=1") == pytest.approx(full, rel=0.05)
    assert rms("FILTER sig=EEG lowpass=5 butterworth=4") < 0.1 * full
    for to in (32, 128):
        r = one(session.eval(f"RESAMPLE sig=EEG sr={to} & STATS sig=EEG").table("STATS", "CH"))
        assert r["N"] == to * 30 * NE and r["RMS"] == pytest.approx(full, rel=0.02)


def test_spindles_found_in_burst(spark):
    r = np.random.default_rng(99)
    x = r.normal(0, 0.05, int(100 * 120))
    for k in range(10):
        x[1000 * k + 500 : 1000 * k + 600] += np.sin(2 * np.pi * 13.5 * np.arange(100) / 100)
    s = Session.create(spark, {"a": {"C3": (100.0, x)}})
    assert one(s.eval("SPINDLES fc=13.5").table("SPINDLES", "CH"))["DENS"] > 1


def test_kernels():
    x = np.random.default_rng(1).normal(size=500)
    s, rc = dsp.ssa(x, 40, 40)
    assert np.abs(rc.sum(0) - x).max() < 1e-8
    imf, rest = dsp.emd(x)
    assert np.abs(sum(imf) + rest - x).max() < 1e-9
    assert dsp.dpss(64, 3, 5) @ dsp.dpss(64, 3, 5).T == pytest.approx(np.eye(5), abs=1e-8)
    t, r = dsp.xcorr(x, np.roll(x, 7), 1.0, 20)
    assert t[r.argmax()] == 7
    names, p = dsp.lda(np.r_[np.zeros((20, 2)), np.ones((20, 2))] + 0.1 * np.random.default_rng(2).normal(size=(40, 2)), np.array(["a"] * 20 + ["b"] * 20), np.array([[0.0, 0], [1, 1]]))
    assert names == ["a", "b"] and p.argmax(1).tolist() == [0, 1]
    assert dsp.moving_average(np.arange(7.0), 3) == pytest.approx([1, 1, 2, 3, 4, 5, 5])
    assert dsp.median_filter(np.array([1.0, 9, 2, 8]), 3).tolist() == [1, 2, 8, 2]


# ---- language and expressions ---------------------------------------------


def test_script_language():
    c = parse("EPOCH len=30 & STATS sig=C[3:4] epoch % note\n+ pct\nLOOP index=i vals=a,b\nX k=${i}\nEND-LOOP\n${v=9}\nIF 0\nY\nFI\nZ q=${v}")
    assert [x.name for x in c] == ["EPOCH", "STATS", "X", "X", "Z"]
    assert c[1].params == {"sig": "C3,C4", "epoch": None, "pct": None} and c[3].get("k") == "b" and c[4].get("q") == "9"
    with pytest.raises(ScriptError):
        parse("IF 1\nX")
    assert parse("% only a comment") == []


@pytest.mark.parametrize("text,message", [("1.2.3", "malformed"), ('"a', "quote"), ("(1 + 2", "bracket"), ("nope + 1", "undefined"), ("v[0]", "index 0"), ("2 3", "missing operator")])
def test_expression_errors(spark, text, message):
    with pytest.raises(ExpressionError, match=message):
        compiled(text, ["v"])


def test_expressions(spark):
    d = spark.createDataFrame([(3, 4.0, None, [1.0, 2.0, 6.0])], "a int, b double, n boolean, v array<double>")
    get = lambda t: one(d.select(compiled(t, d.columns).alias("x")))["x"]
    assert get("-a + 2 * b") == 5 and get("-sqrt(b)") == -2 and get("a / 2") == 1.5 and get("2 ^ 3 + 1") == 9
    assert get("(1 == 2) && n") is None and get("(1 == 1) || n") is None and get("if(n)") is False
    assert get("sum(v)") == 9 and get("v[2]") == 2 and get("sd(v)") == pytest.approx(np.std([1, 2, 6], ddof=1)) and get('ifelse(a > 2, "y", "n")') == "y"
    assert get("v =~ 6") is True and get("\ta\t+ 1") == 4


def test_commands_are_many_and_unknown_ones_refused(session):
    assert len(COMMANDS) > 190
    with pytest.raises(ScriptError):
        session.eval("NO-SUCH-COMMAND")
    with pytest.raises(ScriptError, match="redundant"):
        session.eval("EPOCH-MASK")


# ---- files, API -----------------------------------------------------------


def test_edf_round_trip(session, spark, tmp_path):
    session.eval(f"WRITE edf-dir={tmp_path}")
    recs, samples = edf.read(spark, f"file://{tmp_path}/*.edf", ["EEG"])
    got, want = one(samples), one(session.samples.where("ch = 'EEG'"))
    assert (got["id"], got["ch"], got["sr"]) == ("T1", "EEG", SR) and one(recs)["dur_ns"] == 30 * NE * iv.SECOND
    assert np.abs(np.array(got["v"]) - np.array(want["v"])).max() < 40 / 65535


def test_annotation_files(session, spark, tmp_path):
    (tmp_path / "a.annot").write_text("# sp | spindles\nsp\t.\tC3\t1.5\t2.5\tfrq=13;amp=2\nlo\t00:00:10\t...\nx\te:2\te:2\nz\t.\t.\n")
    got = {r["class"]: r for r in annotfile.read(spark, f"file://{tmp_path}/a.annot").collect()}
    assert got["sp"]["start_ns"] == 1_500_000_000 and got["sp"]["meta"] == {"frq": "13", "amp": "2"}
    assert got["lo"]["stop_ns"] == 30 * iv.SECOND and got["x"]["stop_ns"] == 60 * iv.SECOND and got["z"]["stop_ns"] == 0
    (tmp_path / "b.eannot").write_text("W\nN1\n")
    assert [r["class"] for r in annotfile.read_stages(spark, f"file://{tmp_path}/b.eannot").orderBy("start_ns").collect()] == ["W", "N1"]
    annotfile.write(session.annots, f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", sep="\t").count() == NE


def test_channel_types_positions_and_summary_channels(session, tmp_path):
    s = session.eval("EPOCH & TYPES & REMS & SEDF sig=EEG & CTYPES")
    assert s.table("TYPES", "TYPE").count() == 6
    assert {r["ch"]: r["CTYPE"] for r in s.table("CTYPES", "CH").collect()}["EEG"] == "EEG"
    got = {r["ch"]: r for r in s.table("SEDF", "CH").collect()}
    assert set(got) == {"H1_EEG", "H2_EEG", "H3_EEG"} and got["H1_EEG"]["sr"] == pytest.approx(1 / 30)
    x = np.array(session.samples.where("ch = 'EEG'").first()["v"])
    assert got["H1_EEG"]["v"] == pytest.approx([part.var() for part in x.reshape(NE, -1)])
    (tmp_path / "clocs").write_text("# label x y z\nc3\t0 1,0\n\nCz 0 0 2\n")
    at = {r["ch"]: r for r in session.eval(f"CLOCS file={tmp_path}/clocs").table("CLOCS", "CH").collect()}
    assert (at["C3"]["azimuth"], at["CZ"]["elevation"], at["CZ"]["radius"]) == (90, 90, 2)
    (tmp_path / "bad").write_text("Cz 0 0\n")
    for text in (f"CLOCS file={tmp_path}/bad", "CLOCS"):
        with pytest.raises(ScriptError):
            session.eval(text)


def test_engine(session):
    e = procs.Engine(session.spark).attach(session)
    e.eval("EPOCH & STATS")
    assert "STATS" in e.commands() and ("CH",) in e.strata("STATS")
    assert e.slice(1.0, 2.0, "EEG").count() == SR
    e.insert_signal("T1", "Z", [1.0] * 64, 64.0).insert_annot("T1", "new", [(1, 2)])
    assert e.channels().count() == 3 and e.annots(["new"]).count() == 1
    edits = session.spark.createDataFrame([("T1", "new", iv.SECOND, "shift", 5 * iv.SECOND, None, None)], "id string, class string, start_ns long, op string, a long, b long, c string")
    assert procs.edited(e.annots(["new"]), edits).collect()[0]["start_ns"] == 6 * iv.SECOND


def test_streaming_matches_batch(spark, tmp_path):
    from hypnoframe.streaming import epochs as st

    d = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    q = st.epoch_stats(st.read_events(spark, str(tmp_path / "in"), 10), "1 day").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = d.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert spark.table("days").count() == want
