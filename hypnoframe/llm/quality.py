"""Quality classifier on learned subword embeddings.

A document is the mean of hashed embeddings of its words (runs without white
space, case kept), of word pairs and triples, of the character n-grams of each word,
its borders included, and of the pattern in which each word equals some of the three
before it; a softmax over two classes follows.  (Hashed n-grams of words that were
never seen say nothing, so that without the patterns a text that repeats rare words
looks like any other.)  Embeddings and output weights are learned
together by stochastic gradient descent in numpy on a bounded sample of labelled
documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb

U = np.uint64
BUCKETS = 1 << 17
GRAMS, WORDS = (3, 4), (2, 3)
#: words back that a pattern looks; the first buckets are the patterns'
LOOK_BACK = 3
_KEPT = 1 << LOOK_BACK
_STEP = U(0x9E3779B97F4A7C15)


@dataclass
class QualityModel:
    """``weight``: what a bucket adds to the mean log-odds of class 1 (embedding times output weights)."""

    weight: np.ndarray
    bias: float
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(20)) % U(BUCKETS - _KEPT) + U(_KEPT)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, word n-gram, character n-gram and pattern of the rows."""
    row, _, _, h = tb.words(raw, off, tb.SPACES)
    rows, hashed = [row], [_bucket(h)]
    for size in WORDS:
        m = max(0, len(h) - size + 1)
        with np.errstate(over="ignore"):
            g = h[:m].copy()
            for j in range(1, size):
                g = g * _STEP + h[j : m + j]
        whole = row[:m] == row[size - 1 :]
        rows.append(row[:m][whole])
        hashed.append(_bucket(tb.mix(g[whole] + U(size))))
    pattern = np.zeros(len(h), np.uint64)
    for k in range(1, LOOK_BACK + 1):
        pattern[k:] |= ((h[k:] == h[:-k]) & (row[k:] == row[:-k])).astype(np.uint64) << U(k - 1)
    again = np.flatnonzero(pattern)
    rows.append(row[again])
    hashed.append(pattern[again])
    lead = (raw & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(lead)])[off]  # borders in code points
    text = raw.tobytes().decode("utf-8", "replace")
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n, docs = len(chars), len(off) - 1
    # one border character before each row and after the last
    wide = np.zeros(n + docs + 1, np.uint64)
    place = np.arange(n) + np.repeat(np.arange(docs), np.diff(ends)) + 1
    wide[place] = chars
    blank = (wide <= 32) & ((wide >= 28) | ((wide >= 9) & (wide <= 13)) | (wide == 0))
    wide[blank] = 0
    of = np.searchsorted(ends + np.arange(docs + 1), np.arange(len(wide)), "right") - 1
    with np.errstate(over="ignore"):
        g = wide.copy()
        for k in range(2, max(GRAMS) + 1):
            g = g[:-1] * _STEP + wide[k - 1 :] + U(1)
            if k in GRAMS:
                m = len(g)
                inner = ~blank[1 : m + 1]
                for j in range(2, k - 1):
                    inner &= ~blank[j : m + j]
                at = np.flatnonzero(inner)
                rows.append(of[at + 1])
                hashed.append(_bucket(tb.mix(g[at] + U(k))))
    return np.concatenate(rows), np.concatenate(hashed).astype(np.int64)


def scores(model: QualityModel, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    for a, b in tb.blocks(off):
        row, bucket = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        n = np.bincount(row, minlength=b - a)
        total = np.bincount(row, weights=model.weight[bucket], minlength=b - a)
        out[a:b] = 1.0 / (1.0 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -40, 40)))
    return out


def train(texts: list[str], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Embeddings, output weights and bias by SGD with a linearly falling rate.

    With no examples every score is 0.5; with examples of one class only, the
    scores tend to that class.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    examples = []
    raw, off = tb.buffers(pa.array(texts, pa.string()))
    for a, b in tb.blocks(off, 1 << 17):  # small blocks: the driver's memory is narrow
        row, bucket = features(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key // BUCKETS, np.arange(b - a + 1))
        key, n = (key % BUCKETS).astype(np.int32), n.astype(np.float32)
        examples += [(key[i:j].copy(), n[i:j] / max(n[i:j].sum(), 1)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            now = rate * (1.0 - done / steps)
            done += 1
            at, share = examples[i]
            hidden = share @ table[at] if len(at) else np.zeros(dim, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = p @ out
            out -= now * np.outer(p, hidden)
            bias -= 0.1 * now * p
            if len(at):
                # each feature moves by its share of the document, scaled to the number of kinds
                table[at] -= now * np.outer(share * min(len(at), 256), back).astype(np.float32)
    return QualityModel((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most: int = 3000, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[str], list[int]]:
    """Labelled texts to learn from, chosen by a hash of their id.

    At most ``most`` label rows, and of their documents those of at most
    ``most_chars`` characters.  Rows with a null id or label teach nothing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    n = known.count()
    order = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30))
    some = known.where(order <= int(min(1.0, 1.1 * most / max(n, 1)) * (1 << 30))).withColumn("o", order)
    rows = sorted((r["o"], r["id"], r["y"]) for r in some.orderBy("o", "id", "y").limit(most).collect())
    if not rows:
        return [], []
    picked = docs.sparkSession.createDataFrame([(i, y) for _, i, y in rows], "id long, y int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(f"t is not null and length(t) <= {most_chars}")
    # an id stands for one text, the alphabetically first of those that share it
    got = sorted((r["id"], r["y"], r["t"]) for r in texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("t").alias("t")).collect())
    return [t for _, _, t in got], [y for _, y, _ in got]


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (that the label is 1) and predicted (score >= threshold) of every whole text.

    A null or empty text, or one of white space, has no feature and gets the bias's
    score.  Each row gives one row.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weight.tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = sent.value
        own = QualityModel(np.frombuffer(weight, np.float32), bias)
        for b in batches:
            s = scores(own, *tb.buffers(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
