"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts are weighted sets of five-word shingles (words: runs without ASCII white
space, in lower case; weight: how often the shingle occurs).  Two texts are near
duplicates if their probability Jaccard similarity

    J(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)

is at least the threshold.  Classes are the connected components of that relation.

1. Every row has a number of its own.  Rows of equal text form a group, represented
   by the row of the smallest id; ids may be null or shared by different texts.
2. Each shingle of a distinct text sends arrivals of a Poisson process whose rate
   is its weight to random registers; a register keeps the shingle that came
   first.  A shingle stops as soon as its next arrival is later than the last
   register's first.  Two texts agree in a register with probability J.
3. Bands of registers name buckets.  Every text of a bucket is compared with the
   bucket's leader, its first row, which settles most buckets.
4. In the other buckets, texts outside the leading class are held against the
   texts of other classes by their signatures, block by block inside a task, and
   only pairs whose estimate comes near the threshold leave it: first the best of
   each text, and once those have joined classes, all the rest.  1 - J is a metric,
   so what the leader has measured rules further pairs out.
5. Pairs are verified exactly; linked texts are joined by contracting the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb
from hypnoframe.llm.store import discard, narrow_batches, settled

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 50, 8
#: texts of a bucket that a task holds from each of two tiles
TILE = 4096
#: how many standard errors below the threshold an estimate may lie
SIGMAS = 3.5


def weighted(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first row, rows, row of each shingle, shingle, weight); the weights of a row sum to 1."""
    raw, off = tb.buffers(tb.lowered(col))
    for a, b in tb.blocks(off):
        row, _, _, h = tb.words(raw[off[a] : off[b]], off[a : b + 1] - off[a], tb.SPACES)
        r, s, n = tb.counted(*tb.shingles(row, h, SHINGLE))
        yield a, b - a, r, s, n


def prob_minhash(n_rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures: for each row and register the shingle whose arrival came first (0: none).

    ``row`` ascends.  A round draws the next arrival of each shingle that is still
    live, and looks again only at the registers of rows that still have one.
    """
    total = np.bincount(row, weights=weight, minlength=n_rows)
    rate = weight / total[row]
    first = np.full(n_rows * registers, np.inf)
    held = first.reshape(n_rows, registers)
    # all arrivals of a row with one shingle are that shingle's
    alone = np.bincount(row, minlength=n_rows) == 1
    live = np.flatnonzero(~alone[row])
    time = np.zeros(len(row))
    last = np.full(n_rows, np.inf)
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    k = 0
    with np.errstate(over="ignore"):
        while len(live):
            draw = tb.mix(shingle[live] + U(k + 1) * U(0x9E3779B97F4A7C15))
            time[live] -= np.log(tb.unit(draw)) / rate[live]
            live = live[time[live] < last[row[live]]]  # early termination
            if not len(live):
                break
            place = row[live] * registers + (tb.mix(shingle[live] ^ (U(k + 1) * U(0xD1342543DE82EF95))) % U(registers)).astype(np.int64)
            np.minimum.at(first, place, time[live])
            won = first[place] == time[live]
            seen.append((place[won], time[live][won], shingle[live][won]))
            rows = row[live]
            rows = rows[np.r_[True, rows[1:] != rows[:-1]]]
            last[rows] = held[rows].max(1)
            k += 1
    out = np.zeros(n_rows * registers, U)
    for place, at, s in seen:
        final = first[place] == at
        out[place[final]] = s[final]
    out = out.reshape(n_rows, registers)
    single = np.flatnonzero(alone[row])
    out[row[single]] = shingle[single, None]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket of each band of each signature."""
    with np.errstate(over="ignore"):
        bands = sig.reshape(len(sig), BANDS, ROWS)
        key = np.zeros((len(sig), BANDS), U)
        for j in range(ROWS):
            key = tb.mix((key ^ bands[:, :, j]) * U(0x9E3779B97F4A7C15) + U(j + 1))
        return tb.mix(key + np.arange(1, BANDS + 1, dtype=U))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (ascending keys, weights)."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = wa / wa.sum(), wb / wb.sum()
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    x, y = x[i], y[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    r = x / y
    # for element i: keys with a larger ratio count x_j / x_i, the others y_j / y_i
    above = x[::-1].cumsum()[::-1]
    upto = np.searchsorted(r, r, "right")
    larger = np.r_[above, 0.0][upto]
    smaller = np.r_[0.0, y.cumsum()][upto]
    return float((1.0 / ((larger + only_x) / x + (smaller + only_y) / y)).sum())


def _content(texts: DataFrame) -> DataFrame:
    """rep, keys, weights (none where all are 1), sig (a byte a register) and bands (four bytes a bucket) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n, r, s, w in weighted(b.column(1)):
                cut = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
                heavy = np.bincount(r, weights=w, minlength=n) > np.diff(cut)
                some = heavy[r]
                place = np.concatenate([[0], np.cumsum(np.where(heavy, np.diff(cut), 0))]).astype(np.int32)
                full = prob_minhash(n, r, s, w)
                sig, bands = (tb.mix(full) >> U(56)).astype(np.uint8), (band_keys(full) >> U(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, n), pa.ListArray.from_arrays(pa.array(cut), pa.array(s.astype(np.int64))), pa.ListArray.from_arrays(pa.array(place), pa.array(w[some].astype(np.int32))), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in bands], pa.binary())],
                    names=["rep", "keys", "weights", "sig", "bands"],
                )

    return texts.select("rep", "t").mapInArrow(run, "rep long, keys array<long>, weights array<int>, sig binary, bands binary")


def _signed(rows: DataFrame) -> DataFrame:
    """id, digest of the text, and its buckets (one a band; none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            raw, off = tb.buffers(col)
            digests = pa.array([hashlib.sha256(raw[off[i] : off[i + 1]]).digest() for i in range(len(col))], pa.binary())
            for a, n, r, s, w in weighted(col):
                sig = prob_minhash(n, r, s, w)
                some = np.bincount(r, minlength=n) > 0
                key = band_keys(sig)
                cut = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), digests.slice(a, n), pa.ListArray.from_arrays(pa.array(cut), pa.array(key[some].reshape(-1).view(np.int64)))], names=["id", "digest", "buckets"])

    return rows.mapInArrow(run, "id long, digest binary, buckets array<long>")


def _verified(pairs: DataFrame, content: DataFrame) -> DataFrame:
    """a, b, sim of the pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for side in ("x", "y"):
                k, w = b.column(f"k{side}"), b.column(f"w{side}")
                off = k.offsets.to_numpy()
                keys = k.values.to_numpy().astype(U)
                weights = w.values.to_numpy().astype(np.float64)
                base = w.offsets.to_numpy()
                parts.append([(keys[off[i] : off[i + 1]], weights[base[i] : base[i + 1]] if base[i] < base[i + 1] else np.ones(off[i + 1] - off[i])) for i in range(len(k))])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([similarity(x, y) for x, y in zip(*parts, strict=True)], pa.float64())], names=["a", "b", "sim"])

    x = content.select(F.col("rep").alias("a"), F.col("keys").alias("kx"), F.col("weights").alias("wx"))
    y = content.select(F.col("rep").alias("b"), F.col("keys").alias("ky"), F.col("weights").alias("wy"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "kx", "wx", "ky", "wy").mapInArrow(run, "a long, b long, sim double")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, label: the smallest id of each connected component, for the ids that have an edge.

    A round hooks every id to its smallest neighbour if that is smaller, shortens the
    chains of hooks by pointer jumping, and moves the edges to the ids they end at.
    Edges within one id go and equal ones become one, so that a further round has only
    the edges between what is still apart: at most half of the ids are left each time.
    Only counts reach the driver.
    """
    ids = edges.select(F.col(a).alias("v")).unionByName(edges.select(F.col(b).alias("v"))).distinct()
    left = settled(_apart(edges, F.col(a), F.col(b)), "edges")
    rounds = []
    while _some(left):
        up = settled(left.groupBy("v").agg(F.min("u").alias("label")), "hooks")
        while True:
            to = up.select(F.col("v").alias("label"), F.col("label").alias("further"))
            jumped = settled(up.join(to, "label", "left").select("v", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")), "hooks")
            discard(up)
            up = jumped
            if not _some(up.where("moved")):
                break
        rounds.append(up)
        ends = left.join(up.select("v", F.col("label").alias("lv")), "v").join(up.select(F.col("v").alias("u"), F.col("label").alias("lu")), "u", "left")
        moved = settled(_apart(ends, F.coalesce("lu", "u"), F.col("lv")), "edges")
        discard(left)
        left = moved
    discard(left)
    whole = edges.sparkSession.createDataFrame([], "v long, label long")
    for up in reversed(rounds):
        whole = whole.unionByName(_followed(up, whole))
    labels = settled(ids.join(whole, "v", "left").select("v", F.coalesce("label", "v").alias("label")), "labels")
    for up in rounds:
        discard(up)
    return labels


def _apart(edges: DataFrame, a, b) -> DataFrame:
    """u < v: the different pairs of unlike ends."""
    return edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()


def _followed(labels: DataFrame, further: DataFrame) -> DataFrame:
    """v, label of ``labels``, where a label that ``further`` has a label of is replaced by that."""
    to = further.select(F.col("v").alias("label"), F.col("label").alias("to"))
    return labels.join(to, "label", "left").select("v", F.coalesce("to", "label").alias("label"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """v, label once the links (a, b) are added to the classes: components of the classes, not of all links anew."""
    of_a, of_b = (labels.select(F.col("v").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    between = links.select("a", "b").join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    between = settled(between.where("a != b").distinct(), "between")
    further = components(between)
    discard(between)
    return settled(_followed(labels, further).unionByName(further.join(labels.select("v"), "v", "left_anti")), "labels")


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _labelled(links: DataFrame, spark) -> DataFrame:
    return components(links) if _some(links) else spark.createDataFrame([], "v long, label long")


def _relabelled(state: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, leader, sim with the labels of the text and of its bucket's first leader."""
    own = labels.select(F.col("v").alias("rep"), "label")
    lead = labels.select(F.col("v").alias("leader"), F.col("label").alias("ll"))
    out = state.join(own, "rep", "left").join(lead, "leader", "left")
    return out.select("bucket", "rep", "leader", "sim", F.coalesce("label", "rep").alias("label"), F.coalesce("ll", "leader").alias("ll"))


def _promising(now: DataFrame, content: DataFrame, threshold: float, best_only: bool) -> DataFrame:
    """a, b: pairs of a bucket with different labels whose signatures agree nearly as often as the threshold asks.

    Each text outside the class of its bucket's leader is held against all texts of
    the bucket.  A bucket of more than TILE texts is dealt in tiles to as many tasks
    as it has pairs of tiles, so that a task holds two tiles at most.
    """
    registers = BANDS * ROWS
    least = threshold - SIGMAS * (threshold * (1 - threshold) / registers) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def matched() -> pa.RecordBatch:
            rep, label, ll, sim, tile = (np.array(c) for c in zip(*((x[1], x[2], x[3], x[4], x[5]) for x in held), strict=True))
            sig = np.frombuffer(b"".join(x[6] for x in held), np.uint8).reshape(len(held), registers)
            bands = np.frombuffer(b"".join(x[7] for x in held), np.uint32).reshape(len(held), BANDS)
            here = np.uint32((at[0] & (1 << 64) - 1) >> 32)
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(label != ll):
                # the other side: another class, the other tile if there are two, each pair once
                other = (label != label[i]) & (np.abs(sim - sim[i]) <= 1.0 - threshold + 1e-9)
                if at[1] != at[2]:
                    other &= tile != tile[i]
                j = np.flatnonzero(other)
                agree = (sig[j] == sig[i]).mean(1) if len(j) else np.zeros(0)
                good = np.flatnonzero(agree >= least)
                # texts that share several buckets meet in the first of them
                good = good[bands[i][(bands[j[good]] == bands[i]).argmax(1)] == here] if len(good) else good
                if best_only and len(good):
                    good = good[[agree[good].argmax()]]
                out += [(min(rep[i], rep[k]), max(rep[i], rep[k])) for k in j[good]]
            out = sorted(set(out))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("bucket", "lo", "hi", "rep", "label", "ll", "sim", "tile", "sig", "bands")]
            for bucket, lo, hi, *row in zip(*cols, strict=True):
                if at != (bucket, lo, hi):
                    if held:
                        yield matched()
                    at, held = (bucket, lo, hi), []
                held.append((at, *row))
        if held:
            yield matched()

    open_buckets = now.groupBy("bucket").agg(F.count("*").alias("m"), F.max((F.col("label") != F.col("ll")).cast("int")).alias("r")).where("r > 0")
    rows = now.join(open_buckets, "bucket").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    sides = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("lo"), F.greatest(t, "tile").alias("hi")))
    rows = rows.withColumn("side", F.explode(sides)).select("bucket", "side.lo", "side.hi", "rep", "label", "ll", "sim", "tile")
    rows = settled(rows, "rows").join(content.select("rep", "sig", "bands"), "rep")
    n = max(1, int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "rep")
    return dealt.select("bucket", "lo", "hi", "rep", "label", "ll", "sim", "tile", "sig", "bands").mapInArrow(run, "a long, b long").distinct()


def linked(buckets: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified pairs (a, b, sim) that join all classes, and v, label of the texts with one.

    ``buckets``: bucket, rep.  ``groups``: rep, id, digest.  ``texts``: id, digest, t,
    where a pair of id and digest is there once.
    """
    spark = buckets.sparkSession
    leaders = settled(buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"), "leaders")
    members = settled(buckets.join(leaders, "bucket").select("bucket", "rep", "leader"), "members")
    discard(leaders)
    if not _some(members):
        return spark.createDataFrame([], "a long, b long, sim double"), spark.createDataFrame([], "v long, label long")
    wanted = groups.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.col("id").alias("of"), F.col("digest").alias("sha"))
    content = settled(_content(texts.join(wanted, (F.col("digest") == F.col("sha")) & F.col("id").eqNullSafe(F.col("of")))), "content")
    pairs = settled(members.where("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    measured = settled(_verified(pairs, content), "measured")
    discard(pairs)
    labels = _labelled(measured.where(F.col("sim") >= threshold), spark)
    first = measured.select(F.col("a").alias("rep"), F.col("b").alias("leader"), "sim")
    state = members.join(first, ["rep", "leader"], "left").select("bucket", "rep", "leader", F.coalesce("sim", F.lit(1.0)).alias("sim"))
    for best_only in (True, False):
        now = settled(_relabelled(state, labels), "now")
        if not _some(now.where("label != ll")):
            discard(now)
            break
        known = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = settled(_promising(now, content, threshold, best_only).join(known, ["a", "b"], "left_anti"), "pairs")
        got = settled(_verified(pairs, content), "measured")
        discard(pairs)
        measured = settled(measured.unionByName(got), "measured")
        found = got.where(F.col("sim") >= threshold)
        if _some(found):
            labels = joined(labels, found)
        state = now.select("bucket", "rep", "leader", "sim")
    discard(content)
    return measured.where(F.col("sim") >= threshold), labels


def _digest(text_col: str):
    return F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256))


def _first(id_col: str, row_col: str):
    """The row of the smallest id, rows without an id last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row")))


def _named(classes: DataFrame, ids: DataFrame) -> DataFrame:
    """label, class_id of the classes (label, id) that can't be called by their smallest id: it is null, or a class of a smaller label has it.

    Their class_id is a hash that is no row's id.
    """
    owners = classes.where("id is not null").groupBy("id").agg(F.min("label").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = settled(classes.where("id is null").select("label").unionByName(classes.join(owners, "id").where("label != owner").select("label")), "others")
    salt = 0
    while True:
        named = settled(others.select("label", F.xxhash64("label", F.lit(salt)).alias("class_id")), "named")
        if not _some(named.groupBy("class_id").count().where("count > 1")) and not _some(named.join(ids.select(F.col("id").alias("class_id")), "class_id", "left_semi")):
            return named
        discard(named)
        salt += 1


def _judged(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """id, digest, class_id, kept, gone of each row, and whether rows repeat both id and text.

    kept: the one row that stays of its class; gone: neither it nor a row of the same
    id and text.  A null text has no digest.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    signed = settled(_signed(rows.where("t is not null")).withColumn("row", F.monotonically_increasing_id()), "signed")
    nulls = settled(rows.where("t is null").select("id", (-1 - F.monotonically_increasing_id()).alias("label")), "nulls")
    repeated = _some(signed.groupBy("digest", "id").count().where("count > 1"))
    groups = signed.groupBy("digest").agg(_first("id", "row").alias("f"), F.first("buckets").alias("buckets"))
    groups = settled(groups.select("digest", F.col("f.id").alias("id"), F.col("f.row").alias("rep"), "buckets"), "groups")
    texts = rows.where("t is not null").withColumn("digest", _digest("t"))
    texts = texts.dropDuplicates(["id", "digest"]) if repeated else texts
    _, labels = linked(groups.select("rep", F.explode("buckets").alias("bucket")), groups.select("rep", "id", "digest"), texts, threshold)
    groups = groups.select("digest", "id", "rep").join(labels.select(F.col("v").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = groups.groupBy("label").agg(_first("id", "rep").alias("f")).select("label", F.col("f.id").alias("first_id"), F.col("f.row").alias("first_row"))
    classes = settled(groups.select("digest", "rep", "label").join(first, "label"), "classes")
    all_classes = classes.where("rep = first_row").select("label", F.col("first_id").alias("id")).unionByName(nulls.select("label", "id"))
    if _some(all_classes.groupBy("id").count().where("count > 1 or id is null")):
        named = _named(all_classes, signed.select("id").unionByName(nulls.select("id")))
        classes = settled(classes.join(named, "label", "left").withColumn("class_id", F.coalesce("class_id", "first_id")), "classes")
        nulls = nulls.join(named, "label", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    else:
        classes, nulls = classes.withColumn("class_id", F.col("first_id")), nulls.withColumn("class_id", F.col("id"))
    same = (F.col("rep") == F.col("first_row")) & F.col("id").eqNullSafe(F.col("first_id"))
    out = signed.select("id", "digest", "row").join(classes, "digest").select("id", "digest", "class_id", (F.col("row") == F.col("first_row")).alias("kept"), (~same).alias("gone"))
    alone = nulls.select("id", F.lit(None).cast("binary").alias("digest"), "class_id", F.lit(True).alias("kept"), F.lit(False).alias("gone"))
    return out.unionByName(alone), repeated


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id, kept: one row for each row of ``docs``.

    class_id is the smallest id of the class; where that is null or another class
    has it too, a number that is no row's id.  kept holds for one row of each class,
    one of the smallest id.  Equal texts, empty ones too, are of one class; a text
    without words is alike to equal texts only; a null text is in a class of its
    own.  Rows that repeat an id are all returned, each judged by its own text; a tie
    for the smallest id goes to the row that was read first.  A very long text is
    one row of shingle hashes, in one task.  An empty table gives no rows; only the
    two named columns are read, so others can't clash.
    """
    return _judged(docs, threshold, id_col, text_col)[0].select(F.col("id").alias(id_col), "class_id", "kept")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each class, one of the smallest id (see ``near_duplicates``)."""
    judged, repeated = _judged(docs, threshold, id_col, text_col)
    gone = settled(judged.where("gone").select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")), "gone")
    digest = "digest"
    while digest in docs.columns:
        digest += "_"
    texts = docs.withColumn(digest, _digest(text_col))
    # what goes grows with the corpus, so both sides are dealt out, at every size
    kept = texts.join(gone.hint("merge"), (F.col(digest) == F.col("gone_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("gone_id")), "left_anti")
    if repeated:
        kept = kept.where(F.col(digest).isNotNull()).dropDuplicates([id_col, digest]).unionByName(kept.where(F.col(digest).isNull()))
    return kept.drop(digest)
