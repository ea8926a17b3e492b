"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits in lower case (ASCII punctuation and white
space separate them).  Karp-Rabin hashes of windows of ``min_match`` tokens are
joined between documents and benchmark items:

1. A bitmap of the items' window hashes, at most MOST_BITS wide, goes to every task.
   A document's windows whose bit is unset have no partner; the others leave the
   task with their tokens.  On a large benchmark more windows pass, none is lost.
2. An item's signature is its rarest windows (by how many items have them), as many
   as it takes that the tokens of all its other windows fall short of ``coverage``.
   A document that covers enough of the item has one of these, so the shuffle join
   of windows and signatures finds every pair, and a passage that many items share
   joins nothing as long as each has enough of its own.
3. For each pair, hits are verified by their tokens and grow to maximal matches; the
   longest is marked as a tile again and again, and what other matches lose to it
   is cut off them, until none of ``min_match`` tokens is left.

A document is contaminated by an item if its tiles cover at least ``coverage`` of the
item's tokens, in whatever order the passages stand.  An item of fewer than
``min_match`` tokens is too short to tell a quotation from chance: it matches the
documents that consist of the same tokens.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb
from hypnoframe.llm.store import discard, settled

U = np.uint64
MIN_MATCH, COVERAGE = 5, 0.5
#: binary logarithm of the bitmap's bits at most (8 MB)
MOST_BITS = 26
_PAGE = 1 << 15  # bits of one of Spark's bitmaps


def windows(row: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, hash and number of tokens of each window; a row of fewer than ``size`` tokens is a window of its own."""
    m = len(h) - size + 1
    at, key = np.zeros(0, np.int64), np.zeros(0, U)
    with np.errstate(over="ignore"):
        if m > 0:
            total = np.zeros(m, U)
            for j in range(size):
                total += h[j : j + m] * U(tb._Q[j])
            at = np.flatnonzero(row[:m] == row[size - 1 :])
            key = tb.mix(total[at])
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        count = np.diff(np.r_[head, len(row)])
        few = np.flatnonzero(count < size)
        whole = np.array([(h[a : a + n] * np.array(tb._Q[:n], U)).sum(dtype=U) + U(n) for a, n in zip(head[few], count[few], strict=True)], U)
    length = np.r_[np.full(len(at), size), count[few]]
    at, key = np.r_[at, head[few]], np.r_[key, tb.mix(whole)]
    order = np.argsort(at, kind="stable")
    return at[order], key[order], length[order]


def _texts(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[str]:
    """The tokens of windows, joined by spaces."""
    data = raw.tobytes()
    return [b" ".join(data[start[k] : end[k]] for k in range(a, a + n)).decode("utf-8", "replace") for a, n in zip(at.tolist(), length.tolist(), strict=True)]


def matches(where: dict[str, list[int]], grams: list[str]) -> list[tuple[int, int, int]]:
    """Maximal runs of windows (document position, item position, windows) that both texts have, from the item's last window to its first."""
    out = []
    after: dict[int, int] = {}
    for i in range(len(grams) - 1, -2, -1):
        found = where.get(grams[i], ()) if i >= 0 else ()
        now = {d: after.get(d + 1, 0) + 1 for d in found}
        out += [(d, i + 1, n) for d, n in after.items() if d - 1 not in now]
        after = now
    return out


def tiles(runs: list[tuple[int, int, int]], size: int, total: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiling from maximal runs of windows of ``size`` tokens; ``total``: the item's tokens.

    Longest first; among equals the earliest in the item, then in the document.
    Tiles are (document position, item position, length), overlapping in neither text.
    """
    heap = [(-(n + size - 1), i, d) for d, i, n in runs]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while heap and (total is None or total - len(in_item) >= size):
        n, i, d = heapq.heappop(heap)
        n = -n
        if len(in_item) and any(i + k in in_item or d + k in in_doc for k in range(n)):
            free = 0
            for k in range(n + 1):
                if k < n and i + k not in in_item and d + k not in in_doc:
                    free += 1
                    continue
                if free >= size:
                    heapq.heappush(heap, (-free, i + k - free, d + k - free))
                free = 0
            continue
        in_item.update(range(i, i + n))
        in_doc.update(range(d, d + n))
        out.append((d, i, n))
    return out


def signature(tokens: int, keys: list[int], often: list[int], coverage: float, size: int) -> list[int]:
    """The rarest window hashes of an item, one of which every text has that covers ``coverage`` of its tokens."""
    need = math.ceil(coverage * tokens)
    at = defaultdict(list)
    for place, k in enumerate(keys):
        at[k].append(place)
    order = sorted(at, key=lambda k: (often[at[k][0]], k))
    covered: set[int] = set()
    while order:
        for place in at[order[-1]]:
            covered.update(range(place, min(place + size, tokens)))
        if len(covered) >= need:
            break
        order.pop()
    return order


def _items(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, tokens, keys and grams of each item with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tb.buffers(tb.lowered(b.column(1)))
            for a, z in tb.blocks(off):
                part = raw[off[a] : off[z]]
                row, start, end, h = tb.words(part, off[a : z + 1] - off[a], tb.NON_ALNUM)
                at, key, length = windows(row, h, size)
                cut = np.searchsorted(row[at], np.arange(z - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(np.bincount(row, minlength=z - a).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(key.view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(_texts(part, start, end, at, length), pa.string()))],
                    names=["item_id", "tokens", "keys", "grams"],
                )

    picked = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return picked.mapInArrow(run, "item_id long, tokens int, keys array<long>, grams array<string>").where("tokens > 0").withColumn("item", F.monotonically_increasing_id())


def _bitmap(items: DataFrame) -> tuple[bytes, int]:
    """Bits of the items' window hashes and the binary logarithm of their number."""
    n = items.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(32 * n + 1))))
    slot = items.select(F.explode("keys").alias("key")).select((F.shiftrightunsigned("key", 64 - bits) + 1).alias("slot"))
    pages = slot.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = bytearray((1 << bits) // 8)
    for r in pages.collect():  # at most 2 ** MOST_BITS bits in all
        at = (r["page"] - 1) * _PAGE // 8
        out[at : at + _PAGE // 8] = r["bits"][: len(out) - at]
    return bytes(out), bits


def _signatures(items: DataFrame, coverage: float, size: int) -> DataFrame:
    """key, item: the windows by which documents find an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, tokens, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = sorted(rows, key=lambda r: r["pos"])
                got = signature(tokens, [r["key"] for r in rows], [r["often"] for r in rows], coverage, size)
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array([item] * len(got), pa.int64())], names=["key", "item"])

    spread = items.select("item", "tokens", F.posexplode("keys").alias("pos", "key"))
    often = spread.select("item", "key").distinct().groupBy("key").agg(F.count("*").alias("often"))
    each = spread.join(often, "key").groupBy("item", "tokens").agg(F.collect_list(F.struct("pos", "key", "often")).alias("rows"))
    return each.select("item", "tokens", "rows").mapInArrow(run, "key long, item long")


def _hits(picked: DataFrame, bitmap: tuple[bytes, int], size: int, kind: str) -> DataFrame:
    """row (a number of its own), id, and pos, keys and grams of the windows whose bit is set, for the rows that have any."""
    sent, bits = picked.sparkSession.sparkContext.broadcast(bitmap[0]), bitmap[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            raw, off = tb.buffers(tb.lowered(b.column(1)))
            for a, z in tb.blocks(off):
                part = raw[off[a] : off[z]]
                row, start, end, h = tb.words(part, off[a : z + 1] - off[a], tb.NON_ALNUM)
                at, key, length = windows(row, h, size)
                slot = (key >> U(64 - bits)).astype(np.int64)
                hit = np.flatnonzero((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                if not len(hit):
                    continue
                at, key, length = at[hit], key[hit], length[hit]
                rows, cut = np.unique(row[at], return_index=True)
                cut = pa.array(np.r_[cut, len(at)].astype(np.int32))
                pos = (at - np.searchsorted(row, row[at])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(a + rows)), pa.ListArray.from_arrays(cut, pa.array(pos)), pa.ListArray.from_arrays(cut, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(_texts(part, start, end, at, length), pa.string()))],
                    names=["id", "pos", "keys", "grams"],
                )

    out = picked.select("id", "t").mapInArrow(run, f"id {kind}, pos array<int>, keys array<long>, grams array<string>")
    return out.withColumn("row", F.monotonically_increasing_id())


def _found(picked: DataFrame, benchmark: DataFrame, size: int, coverage: float, item_col: str, item_text: str) -> DataFrame:
    """id, item_id, item_tokens, covered, tiles, coverage for each row of ``picked`` (id, t) and item that contaminates it."""
    spark = picked.sparkSession
    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item_id long, item_tokens long, covered long, tiles long, coverage double"
    items = settled(_items(benchmark, size, item_col, item_text), "items")
    bitmap = _bitmap(items)
    hits = settled(_hits(picked, bitmap, size, kind), "hits")
    signs = settled(_signatures(items, coverage, size), "signatures")
    pairs = hits.select("row", F.explode(F.array_distinct("keys")).alias("key")).join(signs, "key").select("row", "item").distinct()
    some = settled(pairs, "pairs")
    discard(signs)
    none = F.lit(None)
    ours = hits.join(some.select("row").distinct(), "row", "left_semi").select("row", F.lit(0).alias("part"), "id", "pos", "grams", none.cast("long").alias("item_id"), none.cast("int").alias("tokens"))
    theirs = some.join(items, "item").select("row", F.lit(1).alias("part"), none.cast(kind).alias("id"), none.cast("array<int>").alias("pos"), "grams", "item_id", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict[str, list[int]] = {}
        own = None
        for b in batches:
            out: list[tuple] = []
            for k, (part, pos, grams, item_id, tokens) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "pos", "grams", "item_id", "tokens")), strict=True)):
                if part == 0:
                    own, where = b.column("id")[k], defaultdict(list)
                    for p, g in zip(pos, grams, strict=True):
                        where[g].append(p)
                    continue
                n = min(size, tokens)
                least = math.ceil(coverage * tokens)
                # tiles can't cover more of the item than its hits do
                if len({i + j for i, g in enumerate(grams) if g in where for j in range(n)}) < least:
                    continue
                got = tiles(matches(where, grams), n, tokens)
                covered = sum(x for _, _, x in got)
                if covered >= least:
                    out.append((own, item_id, tokens, covered, len(got), covered / tokens))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in cols[0]], b.column("id").type), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.float64())], names=["id", "item_id", "item_tokens", "covered", "tiles", "coverage"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = ours.unionByName(theirs).repartition(n, "row").sortWithinPartitions("row", "part")
    return both.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document row, contaminating item): id_col, item_id, item_tokens, covered, tiles, coverage.

    Texts and items that are null or without tokens match nothing; repeated rows, null
    ids and repeated items are each judged and reported; an empty table on either
    side gives no rows.  Equal matches are tiled in the order of the item, then of
    the document.  Only the named columns are read, so others cannot clash.
    """
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return _found(picked, benchmark, min_match, coverage, item_col, item_text).withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates.

    A row is judged by its text alone, so that rows of one text go or stay together,
    whatever their ids; rows without a text stay.
    """
    digest = "digest"
    while digest in docs.columns:
        digest += "_"
    sha = F.substring(F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256)), 1, 16)
    picked = docs.select(sha.alias("id"), F.col(text_col).cast("string").alias("t"))
    gone = settled(_found(picked, benchmark, min_match, coverage, item_col, item_text).select(F.col("id").alias("gone")).distinct(), "gone")
    return docs.withColumn(digest, sha).join(gone, F.col(digest) == F.col("gone"), "left_anti").drop(digest)
