"""EDF files: header and records as DataFrames, and an encoder."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: widths of the per-signal header fields
WIDTHS = {"label": 16, "transducer": 80, "unit": 8, "pmin": 8, "pmax": 8, "dmin": 8, "dmax": 8, "prefilter": 80, "n": 8, "reserved": 32}


def decode(raw: bytes, keep=None) -> tuple[dict, list[dict]]:
    """Header and signals; only labels that ``keep`` accepts are decoded, the others are skipped by offset."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    text = lambda a, b: raw[a:b].decode("latin-1").strip()
    ns, nr, dur, start = int(text(252, 256)), int(text(236, 244)), float(text(244, 252)), text(168, 184)
    at, cols = 256, {}
    for k, w in WIDTHS.items():
        cols[k] = [text(at + i * w, at + (i + 1) * w) for i in range(ns)]
        at += ns * w
    per = [int(x) for x in cols["n"]]
    width = sum(per)
    if nr < 0:
        nr = (len(raw) - at) // (2 * width)
    body = np.frombuffer(raw, "<i2", nr * width, at).reshape(nr, width)
    out, k = [], 0
    for i in range(ns):
        if not cols["label"][i].startswith("EDF Annotations") and (keep is None or keep(cols["label"][i])):
            pmin, pmax, dmin, dmax = (float(cols[c][i]) for c in ("pmin", "pmax", "dmin", "dmax"))
            gain = (pmax - pmin) / (dmax - dmin)
            out.append({"ch": cols["label"][i], "sr": per[i] / dur, "unit": cols["unit"][i], "v": (body[:, k : k + per[i]].reshape(-1) - dmin) * gain + pmin})
        k += per[i]
    return {"nr": nr, "rec_s": dur, "start": f"{start[6:8]}-{start[3:5]}-{start[:2]} {start[8:].replace('.', ':')}"}, out


def encode(signals: list[tuple[str, float, str, np.ndarray]], rec_s: float = 1.0, start: str = "01.01.8522.00.00") -> bytes:
    """EDF bytes of (label, rate, unit, values); values become 16-bit numbers over each signal's own range."""
    nr = max((int(len(v) / (sr * rec_s)) for _, sr, _, v in signals), default=0)
    pad = lambda x, n: str(x)[:n].ljust(n).encode("latin-1", "replace")
    head = pad("0", 8) + pad("X", 80) + pad("X", 80) + start[:16].encode() + pad(256 * (1 + len(signals)), 8) + pad("", 44) + pad(nr, 8) + pad(f"{rec_s:g}", 8) + pad(len(signals), 4)
    rows, lims = [], []
    for _, sr, _, v in signals:
        n = round(sr * rec_s)
        lo, hi = float(v.min()), float(v.max())
        lo, hi = float(f"{lo - (hi == lo) - abs(lo) * 1e-6:.7g}"[:8]), float(f"{hi + (hi == lo) + abs(hi) * 1e-6:.7g}"[:8])
        lims.append((lo, hi, n))
        q = np.clip(np.round((v[: nr * n] - lo) / (hi - lo) * 65535 - 32768), -32768, 32767).astype("<i2")
        rows.append(np.pad(q, (0, nr * n - len(q))).reshape(nr, n))
    f = lambda get, w: b"".join(pad(get(i), w) for i in range(len(signals)))
    head += f(lambda i: signals[i][0], 16) + f(lambda i: "", 80) + f(lambda i: signals[i][2], 8) + f(lambda i: f"{lims[i][0]:.7g}"[:8], 8) + f(lambda i: f"{lims[i][1]:.7g}"[:8], 8)
    head += f(lambda i: -32768, 8) + f(lambda i: 32767, 8) + f(lambda i: "", 80) + f(lambda i: lims[i][2], 8) + f(lambda i: "", 32)
    return head + (np.concatenate(rows, 1).tobytes() if rows else b"")


def read(spark: SparkSession, path: str, sig: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(recordings, samples) of EDF files, by Spark's binary reader: any store, one task per file or group of files.

    Only channels in ``sig`` are decoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!x]").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.edf(\.?gz|z)?)?$", 1).alias("id"), "content")
    want = {x.upper() for x in sig} if sig else None
    keep = (lambda ch: ch.upper() in want) if want else None

    def traces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i, raw in p.itertuples(index=False):
                yield pd.DataFrame([(i, s["ch"], s["sr"], s["unit"], s["v"]) for s in decode(raw, keep)[1]], columns=["id", "ch", "sr", "unit", "v"])

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, raw in p.itertuples(index=False):
                h = decode(raw, lambda ch: False)[0]
                year = int(h["start"][:2])
                rows.append((i, f"{(1900 if year >= 85 else 2000) + year}{h['start'][2:]}", round(h["nr"] * h["rec_s"] * 1e9), round(h["rec_s"] * 1e9)))
            yield pd.DataFrame(rows, columns=["id", "start", "dur_ns", "rec_ns"])

    return files.mapInPandas(heads, "id string, start string, dur_ns long, rec_ns long"), files.mapInPandas(traces, "id string, ch string, sr double, unit string, v array<double>")


def _store(path: str):
    """(file system, path in it) of a path or address; only stores that pyarrow knows."""
    import os

    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def blocked(raw: bytes, at: list[int], size: int = 65280) -> tuple[bytes, list[int]]:
    """Block-compressed ``raw`` (gzip members that say their length, then an empty one), and for each place in ``at`` its address: member offset * 65536 + place in the member."""
    out, starts = [], []
    for a in [*range(0, len(raw), size), len(raw)]:
        part = raw[a : a + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        starts.append(sum(map(len, out[-1:])) + (starts[-1] if starts else 0))
        out.append(b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out), [starts[k // size] << 16 | k % size for k in at]


def unblocked(f, address: int, n: int) -> bytes:
    """At most ``n`` bytes from an address of a block-compressed file; only the members that hold them are read."""
    c, skip, got = address >> 16, address & 0xFFFF, b""
    while len(got) < n + skip:
        head = f.read_at(18, c)
        if len(head) < 18:
            break
        width = struct.unpack("<H", head[16:18])[0] + 1
        got += zlib.decompress(f.read_at(width, c)[18:-8], -15)
        c += width
    return got[skip : skip + n]


def index_text(raw: bytes, addresses: list[int]) -> str:
    """Index of a block-compressed file: a version line, the record size in bytes, then address, time and texts of each record."""
    ns, dur = int(raw[252:256]), float(raw[244:252])
    width = 2 * sum(int(raw[256 + ns * 216 + 8 * i :][:8]) for i in range(ns))
    return f"EDFZv1\n{width}\n" + "".join(f"{a}\t{round(k * dur * 1e9)}\t.\n" for k, a in enumerate(addresses))


def window(path: str, size: int, a_s: float, b_s: float, keep=None) -> tuple[dict, list[dict], float]:
    """Header, signals and start (s) of the records that [a_s, b_s) meets; only they and the header are read.

    A compressed file without an index beside it is read whole.
    """
    store, p = _store(path)
    with store.open_input_file(p) as f:
        packed, index = f.read_at(2, 0) == b"\x1f\x8b", None
        if packed:
            if store.get_file_info(p + ".idx").size:
                with store.open_input_stream(p + ".idx") as g:
                    index = [int(x.split("\t")[0]) for x in g.read().decode().split("\n")[2:] if x]
                part = lambda a, n: unblocked(f, 0, a + n)[a:]
            else:
                whole = gzip.decompress(f.read_at(size, 0))
                size, part = len(whole), lambda a, n: whole[a : a + n]
        else:
            part = lambda a, n: f.read_at(n, a)
        ns = int(part(252, 4))
        head = part(0, 256 * (1 + ns))
        width = 2 * sum(int(head[256 + ns * 216 + 8 * i :][:8]) for i in range(ns))
        dur, nr = float(head[244:252]), int(head[236:244])
        nr = (len(index) if index else (size - len(head)) // width) if nr < 0 else nr
        first = min(nr, max(0, int(a_s // dur)))
        last = max(first, min(nr, int(-(-b_s // dur))))
        n = (last - first) * width
        body = (unblocked(f, index[first], n) if n else b"") if index else part(len(head) + first * width, n)
    h, signals = decode(head[:236] + str(last - first).ljust(8).encode() + head[244:] + body, keep)
    return h, signals, first * dur


def read_window(spark: SparkSession, path: str, a_s: float, b_s: float, sig: list[str] | None = None) -> DataFrame:
    """(id, ch, sr, unit, start_s, v) of the records that meet [a_s, b_s), by offset: a task reads headers and those records, not files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!x]").load(path).select("path", "length")
    want = {x.upper() for x in sig} if sig else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for p in parts:
            for where, size in p.itertuples(index=False):
                rid = re.search(r"([^/]+?)(\.edf(\.?gz|z)?)?$", where)[1]
                _, found, at = window(where, size, a_s, b_s, (lambda ch: ch.upper() in want) if want else None)
                yield pd.DataFrame([(rid, s["ch"], s["sr"], s["unit"], at, s["v"]) for s in found], columns=["id", "ch", "sr", "unit", "start_s", "v"])

    return files.mapInPandas(run, "id string, ch string, sr double, unit string, start_s double, v array<double>")


def write(session, folder: str, tag: str = "", packed: bool = False) -> None:
    """One EDF file per recording, written by the executors into a shared folder; ``packed``: block-compressed, with an index beside it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i = p["id"].iloc[0]
        raw = encode([(ch, sr, u, np.asarray(v, float)) for ch, sr, u, v in p.sort_values("ch")[["ch", "sr", "unit", "v"]].itertuples(index=False)])
        store, base = _store(folder)
        store.create_dir(base)
        name = f"{base}/{i}{'-' + tag if tag else ''}.edf"
        files = {name: raw}
        if packed:
            ns, nr = int(raw[252:256]), int(raw[236:244])
            head = 256 * (1 + ns)
            body, at = blocked(raw, [head + r * ((len(raw) - head) // max(nr, 1)) for r in range(nr)])
            files = {name + "z": body, name + "z.idx": index_text(raw, at).encode()}
        for where, content in files.items():
            with store.open_output_stream(where) as f:
                f.write(content)
        return pd.DataFrame([(i, len(raw))], columns=["id", "bytes"])

    session.samples.groupBy("id").applyInPandas(run, "id string, bytes long").agg(F.count("*")).collect()


def tals(raw: bytes) -> list[list[tuple[float, float, list[str]]]]:
    """(onset, duration, texts) of each record's annotation lists; the first of a record without a text is its start."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    text = lambda a, b: raw[a:b].decode("latin-1").strip()
    ns, nr = int(text(252, 256)), int(text(236, 244))
    labels = [text(256 + 16 * i, 272 + 16 * i) for i in range(ns)]
    at = 256 + ns * sum(w for k, w in WIDTHS.items() if k not in ("n", "reserved"))
    per = [int(text(at + 8 * i, at + 8 * i + 8)) for i in range(ns)]
    body, width = 256 * (1 + ns), 2 * sum(per)
    nr = (len(raw) - body) // width if nr < 0 else nr
    out = []
    for r in range(nr):
        found, k = [], body + r * width
        for label, n in zip(labels, per, strict=True):
            if label.startswith("EDF Annotations"):
                for part in raw[k : k + 2 * n].split(b"\x00"):
                    if part[:1] in (b"+", b"-"):
                        when, *texts = part.decode("utf-8", "replace").split("\x14")
                        onset, _, length = when.partition("\x15")
                        found.append((float(onset), float(length or 0), [t for t in texts if t]))
            k += 2 * n
        out.append(found)
    return out


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, segments) of EDF+ files: their annotation lists, and the stretches in which records follow one another.

    Files without annotation lists give neither.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!x]").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.edf(\.?gz|z)?)?$", 1).alias("id"), "content")

    def notes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(i, t, t, ".", round(a * 1e9), round((a + d) * 1e9)) for i, raw in p.itertuples(index=False) for rec in tals(raw) for a, d, texts in rec for t in texts]
            yield pd.DataFrame(rows, columns=["id", "class", "inst", "ch", "start_ns", "stop_ns"])

    def stretches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, raw in p.itertuples(index=False):
                n, seg, last = round(decode(raw, lambda ch: False)[0]["rec_s"] * 1e9), 0, None
                for rec in tals(raw):
                    if not rec:
                        continue
                    a = round(rec[0][0] * 1e9)
                    if last is None or a != last:
                        seg += 1
                        rows.append([i, seg, a, a + n])
                    rows[-1][3] = last = a + n
            yield pd.DataFrame(rows, columns=["id", "seg", "start_ns", "stop_ns"])

    annots = files.mapInPandas(notes, "id string, class string, inst string, ch string, start_ns long, stop_ns long").withColumn("meta", F.create_map().cast("map<string,string>"))
    return annots, files.mapInPandas(stretches, "id string, seg int, start_ns long, stop_ns long")


def read_ascii(spark: SparkSession, path: str, sr: float, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(recordings, samples) of text files with a column for each channel (blanks, tabs or commas between); without ``names`` the first line has them, after an optional #."""
    import re

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[a-z]+(\.gz)?)?$", 1).alias("id"), "content")

    def traces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for i, raw in p.itertuples(index=False):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                lines = [x for x in raw.decode("utf-8", "replace").splitlines() if x.strip()]
                own = names or re.split(r"[\s,]+", lines.pop(0).lstrip("#").strip())
                v = np.array([[float(x) for x in re.split(r"[\s,]+", line.strip())] for line in lines]).reshape(-1, len(own))
                rows += [(i, ch, float(sr), "uV", v[:, k]) for k, ch in enumerate(own)]
            yield pd.DataFrame(rows, columns=["id", "ch", "sr", "unit", "v"])

    samples = files.mapInPandas(traces, "id string, ch string, sr double, unit string, v array<double>")
    n = F.max(F.size("v"))
    return samples.groupBy("id").agg(n.alias("n")).select("id", F.lit("1985-01-01 00:00:00").alias("start"), F.round(F.col("n") / sr * 1e9).cast("long").alias("dur_ns"), F.lit(1_000_000_000).cast("long").alias("rec_ns")), samples
