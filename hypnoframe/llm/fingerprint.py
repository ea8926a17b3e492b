"""Bottom-k sketches of word shingles.

A sketch is the k smallest distinct hashes of a text's five-word shingles (words:
runs without ASCII white space, in lower case), written as ``b<k>.<n>.<base64>``:
n hashes of HASH_BITS bits in ascending order, big-endian.  A text with fewer than
five words has one shingle of all its words; one without words has none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb

K = 256
SHINGLE = 5
#: bytes of text in a block of successive documents, about; blocks are as many as the texts need
BLOCK_BYTES = 256 << 20
#: rows a block whose place in the order is looked at to find the blocks' borders
SAMPLES = 8
#: first rows of blocks (of 30 bytes) that may be broadcast
HEADS = 400_000
_WIDTH = (tb.HASH_BITS + 7) // 8


def sketches(col: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text, ascending."""
    raw, off = tb.buffers(tb.lowered(col))
    out: list[np.ndarray] = []
    for a, b in tb.blocks(off):
        row, _, _, h = tb.words(raw[off[a] : off[b]], off[a : b + 1] - off[a], tb.SPACES)
        r, s, _ = tb.counted(*tb.shingles(row, h, size))
        cut = np.searchsorted(r, np.arange(b - a + 1))
        out += [s[i : min(j, i + k)] for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


def encode(sketch: np.ndarray, k: int = K) -> str:
    body = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _WIDTH :].tobytes()
    return f"b{k}.{len(sketch)}.{base64.b64encode(body).decode()}"


def decode(fingerprint: str) -> tuple[int, np.ndarray]:
    k, n, body = fingerprint[1:].split(".")
    wide = np.zeros((int(n), 8), np.uint8)
    wide[:, 8 - _WIDTH :] = np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(n), _WIDTH)
    return int(k), wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The sketch of two parts together: what the parts' joint shingles would give."""
    k, x = decode(a)
    _, y = decode(b)
    return encode(np.union1d(x, y)[:k], k)


def distinct(x: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(x)) if len(x) < k else (k - 1) / ((float(x[k - 1]) + 1) / (1 << tb.HASH_BITS))


def resemblance(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]))
    twice = both[1:] == both[:-1]
    keep = np.r_[True, ~twice]
    union = both[keep]
    if len(union) > k:
        return float(np.count_nonzero(twice & (both[1:] <= union[k - 1]))) / k
    return float(np.count_nonzero(twice)) / len(union)


def containment(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated share of x's shingles that y has: |x & y| = J |x | y|."""
    if not len(x):
        return 1.0
    j = resemblance(x, y, k)
    return min(1.0, j * distinct(np.union1d(x, y)[:k], k) / max(distinct(x, k), 1.0))


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, fingerprint and distinct_shingles of every whole text (null: empty); one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sketches(b.column(1), k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(x, k) for x in got], pa.string()), pa.array([distinct(x, k) for x in got], pa.float64())], names=["id", "fingerprint", "distinct_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return picked.mapInArrow(run, f"id {kind}, fingerprint string, distinct_shingles double").withColumnRenamed("id", id_col)


def _order_keys(none: np.ndarray, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys whose byte order is that of (none, ids, h)."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = none
    for at, x in ((1, ids), (9, h)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").reshape(-1)


def with_successors(docs: DataFrame, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, turn, none, id, t, own) in which each own row is followed by its successor.

    The order is that of ids, null ids last, and of a hash of the text among rows
    that share one.  It is cut into blocks; the first row of each block is copied to
    the end of the block before, and the first of all to the end of the last.  What
    passes through the driver is SAMPLES keys of 17 bytes for each block.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t")).select(F.col("id").isNull().cast("int").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("t").alias("h"), "t")
    key = F.struct("none", "id", "h")
    size = base.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes"), F.min(key).alias("first")).first()
    if not size["n"]:
        return base.select(F.lit(0).alias("block"), F.lit(0).alias("turn"), "none", "id", "t", F.lit(True).alias("own"))
    blocks = blocks or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["bytes"] // BLOCK_BYTES))
    share = min(1.0, SAMPLES * blocks / size["n"])
    some = base.where(F.pmod(F.xxhash64(F.lit("border"), "none", "id", "h"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("none", "id", "h").distinct().toArrow()
    keys = np.sort(_order_keys(*(c.to_numpy() for c in some.columns))) if some.num_rows else np.zeros(0, "S17")
    at = np.unique(np.arange(1, blocks) * len(keys) // blocks)
    first = _order_keys(*(np.array([size["first"][c]]) for c in ("none", "id", "h")))
    cuts = np.unique(keys[at[at < len(keys)]])
    cuts = cuts[cuts > first[0]]

    @F.pandas_udf("int")
    def block_of(none, ids, h):
        import pandas as pd

        return pd.Series(np.searchsorted(cuts, _order_keys(none.to_numpy(), ids.to_numpy(), h.to_numpy()), "right").astype(np.int32))

    # a cut is the key of its block's first row
    raw = np.frombuffer(b"".join(c.ljust(17, b"\0") for c in [*cuts.tolist(), first[0]]), np.uint8).reshape(-1, 17)
    ids, h = (np.ascontiguousarray(raw[:, a : a + 8]).view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63) for a in (1, 9))
    heads = [(int(x), int(i), int(j), min(k, len(cuts)), int(k == len(cuts))) for k, (x, i, j) in enumerate(zip(raw[:, 0], ids.view(np.int64), h.view(np.int64), strict=True))]
    heads = spark.createDataFrame(heads, "none int, id long, h long, block int, turn int")
    # a row a block, of which there is one for each 256 MB of text; beyond the bound the join decides for itself
    heads = F.broadcast(heads) if len(cuts) < HEADS else heads
    own = base.select(block_of("none", "id", "h").alias("block"), F.lit(0).alias("turn"), "none", "id", "h", "t", F.lit(True).alias("own"))
    copies = base.join(heads, ["none", "id", "h"]).select("block", "turn", "none", "id", "h", "t", F.lit(False).alias("own"))
    return own.unionByName(copies).repartition(len(cuts) + 1, "block").sortWithinPartitions("block", "turn", "none", "id", "h", F.desc("own"), "t")


def edited_fingerprints(docs: DataFrame, k: int = K, blocks: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text replaces the last floor(n/2) code points by the first as many
    (or all) of the next document in ascending id; after the last comes the first.
    A null text is empty, and two texts without words are alike (1).  Every row gives
    one row: null ids come last, and rows that share an id follow one another in the
    order of a hash of their texts.  An empty table gives no rows, a single row is
    its own successor; only the two named columns are read, so others can't clash.
    A very long text is held once, with its successor.  Columns: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def emit(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        # rows: id, text, next text; in order, so a sketch serves as the next one's too
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, u in rows]
        texts = [t for _, t, _ in rows]
        own = sketches(pa.array([*texts, rows[-1][2]], pa.string()), k)
        changed = sketches(pa.array(edited, pa.string()), k)
        follow = own[1:]
        for i in range(len(rows) - 1):
            if rows[i][2] is not texts[i + 1] and rows[i][2] != texts[i + 1]:
                follow[i] = sketches(pa.array([rows[i][2]], pa.string()), k)[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([encode(x, k) for x in own[:-1]], pa.string()),
                pa.array([encode(x, k) for x in changed], pa.string()),
                pa.array([resemblance(x, y, k) for x, y in zip(own[:-1], changed, strict=True)], pa.float64()),
                pa.array([resemblance(x, y, k) for x, y in zip(own[:-1], follow, strict=True)], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last own row, whose successor isn't known yet
        out: list[tuple[int | None, str, str]] = []
        size = 0
        for b in batches:
            for block, none, at, text, own in zip(*(b.column(c).to_pylist() for c in ("block", "none", "id", "t", "own")), strict=True):
                if held and held[0] == block:
                    out.append((held[1], held[2], text))
                    size += len(held[2])
                    held = None
                    if size > 1 << 20:
                        yield emit(out)
                        out, size = [], 0
                held = (block, None if none else at, text) if own else None
        if out:
            yield emit(out)

    rows = with_successors(docs, blocks, id_col, text_col)
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
