"""Plans and kernels that must not grow faster than their input."""

import datetime as dt
import math
import re
import tracemalloc

import numpy as np
import pytest

from hypnoframe.functions import dsp, stats
from hypnoframe.operators import epochs as ep
from hypnoframe.operators import hypno
from hypnoframe.operators import intervals as iv
from hypnoframe.plans import registry
from hypnoframe.plans.session import Session


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A small events table: three users, two days; one purchase has no length."""
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(k, t0 + dt.timedelta(minutes=37 * k), k % 3, kinds[k // 3 % 5], float(k * 29 % 60), "") for k in range(72)]
    rows.append((72, t0 + dt.timedelta(days=1, hours=23), 2, "purchase", 0.0, ""))
    d = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["espan", "mask_if", "mask_ifnot", "mask_if_all", "mask_if_spanned", "mask_all_then_unmask_if", "flagship_epoch_mask_stats", "hypno_n2_direction"])
def test_epochs_are_not_broadcast(spark, events, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, events))


def test_stages_around_epochs_against_a_loop(spark):
    stages = ["N2", "N2", "N3", "N2", "W", "N2", "N2", "R", "N2", "N3", "N2"]
    h = spark.createDataFrame([(i, e + 1, s) for i in (1, 2) for e, s in enumerate(stages[i - 1 :])], "id long, e long, stage string")
    d = hypno.n2_direction(h)
    assert "unboundedfollowing" not in plan(d).lower()

    def score(x, k):
        left = next((s for s in reversed(x[:k]) if s != "N2"), None)
        right = next((s for s in x[k + 1 :] if s != "N2"), None)
        a, b = (None if s is None else 1.0 if s == "N3" else -1.0 for s in (left, right))
        got = [v for v in (a, None if b is None else -b) if v is not None]
        return sum(got) / max(1, len(got))

    want = {(i, k + 1): score(stages[i - 1 :], k) for i in (1, 2) for k, s in enumerate(stages[i - 1 :]) if s == "N2"}
    assert {(r["id"], r["e"]): r["score"] for r in d.collect()} == want


def test_nearest_reads_no_frame_to_the_end(spark):
    seeds = spark.createDataFrame([(1, t) for t in (0, 5, 10, 10, 21)], "id long, t_ns long")
    others = spark.createDataFrame([(1, t) for t in (5, 9, 20)], "id long, t_ns long")
    d = iv.nearest(seeds, others, ["id"])
    assert "unboundedfollowing" not in plan(d).lower()
    assert sorted((r["t_ns"], r["prev_t"], r["next_t"]) for r in d.collect() if r["prev_t"] is not None) == [(5, 5, 9), (10, 9, 20), (10, 9, 20), (21, 20, None)]


def test_epochs_without_length_hold_no_sample(spark):
    points = spark.createDataFrame([(1, 10), (1, 20)], "id long, t_ns long")
    eps = spark.createDataFrame([(1, 10, 10, False), (1, 15, 21, False)], "id long, start_ns long, stop_ns long, masked boolean")
    assert [r["t_ns"] for r in ep.retained(points, eps).collect()] == [20]


# ---- kernels against what they were written as at first -------------------


def test_shifted_couplings_against_rolled_traces():
    r = np.random.default_rng(3)
    phase, amp = r.uniform(-3, 3, 200), r.uniform(0, 2, 200)
    e, draw = np.exp(1j * phase), np.random.default_rng(1)
    null = np.array([abs((np.roll(amp, draw.integers(1, 200)) * e).mean()) for _ in range(50)])
    obs = abs((amp * e).mean())
    assert dsp.phase_amplitude(phase, amp, 50) == pytest.approx(((obs - null.mean()) / null.std(), (1 + (null >= obs).sum()) / 51))
    assert dsp._shifts(200, 50, 1) is dsp._shifts(200, 50, 1)


def test_designs_are_made_once():
    assert dsp.dpss(64, 3, 5) is dsp.dpss(64, 3, 5)
    assert dsp._designed(24.0, "bandpass", (2, 4), 0.02, 1.0) is dsp._designed(24.0, "bandpass", (2, 4), 0.02, 1.0)


def test_sample_entropy_holds_no_cube():
    x = np.random.default_rng(5).normal(size=1500)
    tracemalloc.start()
    dsp.sample_entropy(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 * 1500 * 8 * 3.2  # of a block two matrices of doubles, and flags; the cube was three and a copy


@pytest.mark.parametrize("n", [1, 2, 7, 50, 80])
def test_trailing_max(n):
    x = np.random.default_rng(n).normal(size=50)
    assert dsp.trailing_max(x, n).tolist() == [x[max(0, i - n + 1) : i + 1].max() for i in range(50)]


def test_hjorth_numbers_of_rows():
    x = np.random.default_rng(1).normal(size=(4, 24))
    x[1], x[2] = 0, 5
    assert np.array(dsp.hjorths(x)).T.tolist() == [pytest.approx(dsp.hjorth(v)) for v in x]


def test_histogram_parts_are_as_in_sql():
    # (x - lo) / (hi - lo) * 100 rounds to 29 from below, an edge of the histogram
    x = np.array([0.0, 29.0, 100.0, 57.0, 58.0])
    assert dsp.bins(x / 7, 100).tolist() == [min(99, math.floor(v / (100 / 7) * 100)) for v in (x / 7).tolist()]
    assert dsp.bins(np.full(3, 4.0), 100).tolist() == [50] * 3


def test_direct_spectra_are_the_spectra():
    x = np.random.default_rng(1).normal(size=100)
    (f, p), (g, q) = dsp.direct_spectra(x, 24.0, 1, 0.5), dsp.spectra(x, 24.0, 1, 0.5, "hann")
    assert f == pytest.approx(g) and p == pytest.approx(q, rel=1e-9, abs=1e-15)


def test_direct_spectra_are_summed_in_order():
    # of the first bin, sample by sample and without numpy
    x = np.random.default_rng(4).normal(size=24)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * j / 23.0) for j in range(24)]
    re = im = ww = 0.0
    for j in range(24):
        re, im, ww = re + x[j] * w[j] * math.cos(2 * math.pi * 1 * j / 24.0), im + x[j] * w[j] * math.sin(2 * math.pi * 1 * j / 24.0), ww + w[j] * w[j]
    assert dsp.direct_spectra(x, 24.0, 1, 0.5)[1][0, 1] == (re * re + im * im) * 2 / (24.0 * ww)


def test_points_within_the_other_set_are_kept(spark):
    a = spark.createDataFrame([(1, 5, 5), (1, 20, 30), (1, 50, 50), (1, 60, 60)], "id long, start_ns long, stop_ns long")
    b = spark.createDataFrame([(1, 0, 10), (1, 25, 25), (1, 28, 40), (1, 50, 55), (1, 60, 60)], "id long, start_ns long, stop_ns long")
    # not those at a start, nor two points
    assert sorted(r[1:] for r in iv.intersection(a, b, ["id"]).collect()) == [(5, 5), (25, 25), (28, 30)]


# ---- traces ---------------------------------------------------------------


def traces(spark, n=40, chs=("a", "b"), sr=8.0):
    r = np.random.default_rng(2)
    return Session.create(spark, {"T1": {ch: (sr, r.normal(size=n)) for ch in chs}, "T2": {chs[0]: (sr, r.normal(size=n))}}, [("T1", "s", 0, 1), ("T1", "o", 2, 3)])


def test_kernels_get_small_batches(spark, events):
    for key in ("maxBytesPerBatch", "maxRecordsPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    registry.QUERIES["cmd_moving_average_stats"](spark, events)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_difference_doesnt_name_its_array_in_a_lambda(spark, events):
    d = registry.QUERIES["sig_1fnorm"](spark, events)
    text = plan(d)
    assert "element_at(v" not in text and not re.search(r"Filter \(?\(?size\(transform", text)
    s = traces(spark)
    x = {(r["id"], r["ch"]): r["v"] for r in s.samples.collect()}
    for r in s.eval("1FNORM").samples.collect():
        assert r["v"] == pytest.approx([0.0, *np.diff(x[r["id"], r["ch"]])])


def test_matrix_rows_and_columns(spark):
    s = traces(spark)
    x = {(r["id"], r["ch"]): r["v"] for r in s.samples.collect()}
    d = s.eval("MATRIX").table("MATRIX")
    assert d.columns == ["id", "t", "a", "b"] and "arrays_zip" in plan(d)
    assert {(r["id"], round(r["t"] * 8)): (r["a"], r["b"]) for r in d.collect()} == {(i, k): (x[i, "a"][k], x[i, "b"][k] if (i, "b") in x else None) for i in ("T1", "T2") for k in range(40)}


def test_overlap_counts_are_summed_in_the_task(spark):
    s = traces(spark).eval("OVERLAP seed=s other=o nreps=30")
    r = s.table("OVERLAP", "SEED").collect()[0]
    assert r["OBS"] == 0 and 0 <= r["EXP"] <= 1 and r["P"] == pytest.approx(1.0)


def test_epochs_of_traces_are_dealt_by_number(spark):
    text = plan(traces(spark).eval("EPOCH len=1 & MSE s=1,2,1").table("MSE", "CH", "SCALE"))
    assert "REPARTITION_BY_NUM" in text and "ShuffledHashJoin" in text


def test_summary_channels_of_uneven_epochs(spark):
    s = traces(spark, n=44).eval("EPOCH len=2 & SEDF")
    x = {(r["id"], r["ch"]): np.array(r["v"]) for r in s.samples.collect()}
    for r in s.table("SEDF", "CH").collect():
        f = {"M": np.mean, "L": np.min, "U": np.max}[r["ch"][0]]
        v = x[r["id"], r["ch"][2:]]
        assert r["sr"] == 0.5 and r["v"] == pytest.approx([f(v[k : k + 16]) for k in (0, 16)])


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_percentile_of_a_large_group_orders_no_group(spark, p):
    r = np.random.default_rng(9)
    data = {None: [1.0, 1.0, 2.0], "a": [*r.normal(0, 1e6, 500).round(2), -0.0, 0.0, math.inf, -math.inf, math.nan], "b": [7.0] * 9}
    d = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    got = stats.trunc_percentile(d, ["k"], "v", p)
    assert "row_number" not in plan(got)
    order = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    want = {k: sorted(vs, key=order)[min(len(vs) - 1, int(len(vs) * p))] for k, vs in data.items()}
    assert {r["k"]: str(r["pctl"] + 0.0) for r in got.collect()} == {k: str(v + 0.0) for k, v in want.items()}
