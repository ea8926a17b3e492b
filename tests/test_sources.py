"""Block-compressed EDF files, reads by offset, feature lists and table tools."""

from __future__ import annotations

import gzip

import numpy as np
import pytest

from hypnoframe.functions import dsp
from hypnoframe.plans.session import Session
from hypnoframe.sources import edf


@pytest.fixture
def session(spark):
    x = np.random.default_rng(1).normal(size=256 * 600)
    return Session.create(spark, {"A": {"EEG": (256.0, x), "AUX": (32.0, dsp.sine(32, 600, 0.1))}, "B": {"EEG": (256.0, -x)}})


@pytest.mark.parametrize("packed", [False, True])
def test_records_read_by_offset(spark, session, tmp_path, packed):
    session.eval(f"WRITE edf-dir={tmp_path}/out" + (" edfz" if packed else ""))
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == (["A.edfz", "A.edfz.idx", "B.edfz", "B.edfz.idx"] if packed else ["A.edf", "B.edf"])
    recs, whole = edf.read(spark, f"{tmp_path}/out")
    assert sorted((r["id"], r["dur_ns"]) for r in recs.collect()) == [("A", 600 * 10**9), ("B", 600 * 10**9)]
    full = {(r["id"], r["ch"]): np.array(r["v"]) for r in whole.collect()}
    for a, b in ((0, 1), (99.5, 103.2), (598, 700), (700, 800)):
        lo, hi = min(600, int(a)), min(600, int(np.ceil(b)))
        part = {(r["id"], r["ch"]): (r["start_s"], np.array(r["v"]), r["sr"]) for r in edf.read_window(spark, f"{tmp_path}/out", a, b).collect()}
        assert part.keys() == full.keys()
        for k, (at, v, sr) in part.items():
            assert at == lo and np.array_equal(v, full[k][round(lo * sr) : round(hi * sr)])
    assert [r["ch"] for r in edf.read_window(spark, f"{tmp_path}/out", 0, 5, ["aux"]).collect()] == ["AUX"]


def test_only_the_members_asked_for_are_read():
    raw = np.random.default_rng(2).integers(0, 9, 400_000, dtype="u1").tobytes()
    at = list(range(0, len(raw), 7777))
    packed, where = edf.blocked(raw, at)
    assert gzip.decompress(packed) == raw

    class File:
        read = 0

        def read_at(self, n, a):
            self.read += len(packed[a : a + n])
            return packed[a : a + n]

    for k, a in zip(at, where, strict=True):
        f = File()
        assert edf.unblocked(f, a, 100) == raw[k : k + 100] and f.read < len(packed) / 2
    assert edf.unblocked(File(), where[-1], 10**6) == raw[at[-1] :]
    assert edf.blocked(b"", [])[0][:4] == b"\x1f\x8b\x08\x04"


def test_feature_lists(spark, tmp_path):
    from hypnoframe.sources import annotfile

    (tmp_path / "sp.ftr").write_text("10\t20\tA\tamp=3\tflag\tq=a=b\tamp=4\nshort\tline\n5\t5\tB\n")
    r = {x["inst"]: x for x in annotfile.read_features(spark, f"{tmp_path}/sp.ftr").collect()}
    assert (r["A"]["class"], r["A"]["start_ns"], r["A"]["stop_ns"], r["A"]["meta"]) == ("sp", 10, 20, {"amp": "4", "flag": "", "q": "a=b"})
    assert r["B"]["meta"] == {} and len(r) == 2
    (tmp_path / "bad.ftr").write_text("9\t3\tA\n")
    with pytest.raises(Exception, match="bad feature line"):
        annotfile.read_features(spark, f"{tmp_path}/bad.ftr").collect()


def test_sample_list_built_and_validated(spark, tmp_path):
    from hypnoframe.sources import annotfile

    for n in ("a/x1.edf", "a/x1.annot", "a/x1-nsrr.xml", "b/x2.edf.gz", "b/x3.annot", "notes.pdf"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("-")
    s = annotfile.build_sample_list(spark, str(tmp_path))
    got = {r["id"]: (r["edf"].rsplit("/", 1)[1], [a.rsplit("/", 1)[1] for a in r["annots"]]) for r in s.collect()}
    assert got == {"x1": ("x1.edf", ["x1-nsrr.xml", "x1.annot"]), "x2": ("x2.edf.gz", [])}
    found = s.selectExpr("explode(concat(array(edf), annots)) AS path").where("path NOT LIKE '%annot'")
    v = {r["id"]: (r["ok"], len(r["missing"])) for r in annotfile.validated(s, found).collect()}
    assert v == {"x1": (False, 1), "x2": (True, 0)}
    assert not any(r["ok"] for r in annotfile.validated(s.unionByName(s), found).collect())


def test_table_tools(spark):
    from hypnoframe.operators import wide

    d = spark.createDataFrame([("a", "1", None, "."), ("a", "NA", "x", None), ("b", None, "", "NA")], "id string, p string, q string, r string")
    assert [tuple(r) for r in wide.filled_rows(d, ["id"]).collect()] == [("a", "1", "x", None)]
    assert wide.filled_rows(d, ["id"], True).count() == 2
    with pytest.raises(Exception, match="different values of p"):
        wide.filled_rows(d.unionByName(spark.createDataFrame([("a", "2", None, None)], d.schema)), ["id"]).collect()
    t = spark.createDataFrame([("a", "-9", "7", "z"), ("b", "1.5", "x", "y")], "id string, Age string, n string, junk string")
    got = wide.typed(t, ["id"], [("AGE", "num", ["-9"]), ("N", "int", []), ("SEX", "text", [])])
    assert got.columns == ["id", "AGE", "N"] and sorted(map(tuple, got.collect())) == [("a", None, 7), ("b", 1.5, None)]
    assert wide.joined([t.select("id", "n"), d.select("id", "p").where("p = '1'")], ["id"]).count() == 2
    with pytest.raises(ValueError, match="two tables"):
        wide.joined([t, t], ["id"])
    m = wide.mapped_labels(spark.createDataFrame([("C3-M2",), (" eeg  fpz cz ",), ("zz",), (None,)], "ch string"), "ch", [("C3_(M2|A2)", "C3"), ("EEG.*", "EEG")])
    assert [r["label"] for r in m.collect()] == ["C3", "EEG", None, None]
    big = spark.range(1000).selectExpr("id % 3 AS g", "id")
    one, two = (sorted(map(tuple, wide.picked(big.repartition(k), ["g"], 7).collect())) for k in (1, 9))
    assert one == two and len(one) == 21
    res = spark.createDataFrame([("i", "PSD", {"CH": "A"}, "V", 1.0), ("i", "PSD", {"CH": "B"}, "V", 2.0), ("j", "X", {}, "W", 3.0)], "id string, cmd string, strata map<string,string>, var string, d double")
    assert [r["d"] for r in wide.extracted(res, ids=["i"], levels={"CH": ["A", "B"]}, without={"CH": ["B"]}).collect()] == [1.0]
    assert [r["d"] for r in wide.extracted(res, without={"CH": ["A", "B"]}).collect()] == [3.0]
