"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order.  Under statistics frozen
after training, a byte costs -log2 of its PPM probability (method C: in a context
seen n times before d different bytes, a byte seen c times has c/(n+d), an escape
to the next shorter context d/(n+d); after the empty context, 1/256).  The text's
code length is the exact sum over all its bytes, and the language with the
shortest code wins.

Each language's tree is compiled into an automaton whose states are the contexts: a
table gives the next state and the cost of each byte, so scoring is two table
look-ups a byte and language, made for thousands of stretches of text side by side.
Tables grow with the number of languages, and one language's don't depend on the
others'.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb
from hypnoframe.llm.store import narrow_batches

UNDETERMINED = "und"


@dataclass
class PPMModel:
    """Context counts per language: order -> (context keys, byte, count), keys packed big-endian."""

    languages: list[str]
    order: int
    counts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


#: contexts that a language keeps at most
CONTEXTS = 8000


def train(texts: list[tuple[str, str]], order: int = 4, contexts: int = CONTEXTS) -> PPMModel:
    """Model of (text, language) pairs.

    A language with more than ``contexts`` contexts loses its rarest, all of the
    same frequency together (a context's shorter forms are at least as frequent, so
    they stay); one with fewer keeps all, those seen once too.  Without any text,
    the model has no language and every prediction is ``und``.
    """
    languages = sorted({lang for _, lang in texts})
    kept: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    for lang in languages:
        parts = [np.frombuffer(t.encode(), np.uint8).astype(np.uint64) for t, of in texts if of == lang]
        own, seen = [], []
        for k in range(order + 1):
            keys = []
            for x in parts:
                if len(x) > k:
                    m = len(x) - k
                    key = np.zeros(m, np.uint64)
                    for j in range(k + 1):
                        key = (key << np.uint64(8)) | x[j : j + m]
                    keys.append(key)
            u, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            ctx = u >> np.uint64(8)
            _, at = np.unique(ctx, return_inverse=True)
            often = np.bincount(at, weights=c).astype(np.int64) if len(at) else np.zeros(0, np.int64)
            own.append((ctx, (u & np.uint64(255)).astype(np.uint8), c, often[at] if len(at) else often))
            seen.append(often)
        counts = np.sort(np.concatenate(seen))[::-1]
        least = int(counts[contexts]) + 1 if len(counts) > contexts else 1
        rows = []
        for k, (ctx, byte, n, often) in enumerate(own):
            ok = often >= least if k else np.ones(len(ctx), bool)
            rows.append((ctx[ok], byte[ok], n[ok]))
        kept.append(rows)
    return PPMModel(languages, order, kept)


class Automaton:
    """A compiled language: ``step`` and ``cost`` by state * width + symbol."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        K = self.order = len(counts) - 1
        used = np.unique(counts[0][1])
        self.width = A = len(used) + 1
        self.symbol = np.full(256, A - 1, np.uint16)  # the last symbol: bytes never seen
        self.symbol[used] = np.arange(len(used))
        levels = [np.unique(ctx) for ctx, _, _ in counts]
        levels[0] = np.zeros(1, np.uint64)
        first = np.cumsum([0, *(len(x) for x in levels)])

        def find(k: int, key: np.ndarray) -> np.ndarray:
            """State of each context of length k, -1 where there is none."""
            at = np.minimum(np.searchsorted(levels[k], key), max(len(levels[k]) - 1, 0))
            return np.where(levels[k][at] == key, at + first[k], -1) if len(levels[k]) else np.full(len(key), -1)

        cost = np.zeros((int(first[-1]), A), np.float32)
        for k in range(K + 1):
            rows = slice(int(first[k]), int(first[k + 1]))
            if k == 0:
                base = np.full((1, A), 8.0)
            else:
                short = levels[k] & np.uint64((1 << 8 * (k - 1)) - 1)
                base = cost[find(k - 1, short)].astype(np.float64)
            ctx, byte, n = counts[k]
            if len(ctx):
                at = find(k, ctx) - first[k]
                total = np.bincount(at, weights=n, minlength=len(levels[k]))
                kinds = np.bincount(at, minlength=len(levels[k]))
                base += (np.log2(total + kinds) - np.log2(kinds))[:, None]
                base[at, self.symbol[byte]] = np.log2(total[at] + kinds[at]) - np.log2(n)
            cost[rows] = base
        step = np.zeros((int(first[-1]), A), np.int32)
        for k in range(K + 1):
            rows = np.arange(first[k], first[k + 1])
            for s, byte in enumerate(used):
                grown = (levels[k] << np.uint64(8)) | np.uint64(byte)
                to = np.full(len(rows), 0)
                todo = np.ones(len(rows), bool)
                for j in range(min(k + 1, K), 0, -1):
                    got = find(j, grown[todo] & np.uint64((1 << 8 * j) - 1))
                    at = np.flatnonzero(todo)
                    to[at[got >= 0]] = got[got >= 0]
                    todo[at[got >= 0]] = False
                    if not todo.any():
                        break
                step[rows, s] = to
        self.step, self.cost = step.reshape(-1) * A, cost.reshape(-1)


class Scorer:
    """The compiled languages of a model."""

    def __init__(self, model: PPMModel):
        self.languages, self.order = model.languages, model.order
        self.automata = [Automaton(c) for c in model.counts]

    def code_lengths(self, raw: np.ndarray, off: np.ndarray, stretch: int = 512) -> np.ndarray:
        """Bits of each row in each language.

        Rows are scored in stretches side by side; a stretch within a row first
        walks the ``order`` bytes before it, so its state is the one a single walk
        from the row's start would have.
        """
        n, K = len(off) - 1, self.order
        bits = np.zeros((n, len(self.languages)))
        size = np.diff(off)
        parts = -(-size // stretch)
        row = np.repeat(np.arange(n), parts)
        if not len(row):
            return bits
        index = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = off[:-1][row] + index * stretch
        length = np.minimum(stretch, off[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        row, start, length, index = row[order], start[order], length[order], index[order]
        inner = np.flatnonzero(index)
        live = np.searchsorted(-length, -np.arange(stretch), "left")  # stretches longer than t
        for lang, auto in enumerate(self.automata):
            sym = auto.symbol[raw].astype(np.int32)
            state = np.zeros(len(row), np.int32)
            for j in range(-K, 0):
                state[inner] = auto.step[state[inner] + sym[start[inner] + j]]
            spent = np.zeros(len(row), np.float64)
            for t in range(int(length[0])):
                m = int(live[t])
                at = state[:m] + sym[start[:m] + t]
                spent[:m] += auto.cost[at]
                state[:m] = auto.step[at]
            bits[:, lang] = np.bincount(row, weights=spent, minlength=n)
        return bits


_compiled: dict[str, Scorer] = {}


def compiled(model: PPMModel) -> Scorer:
    if model.uid not in _compiled:
        _compiled.clear()
        _compiled[model.uid] = Scorer(model)
    return _compiled[model.uid]


def sample(docs: DataFrame, per_language: int = 250, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """Whole labelled texts to learn from, of every language, chosen by a hash of id and text.

    Bounds, both parameters: texts a language, and the length of a text that may be
    chosen.  Rows with a null text or language teach nothing.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null and length(t) between 1 and %d" % most_chars)
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return []
    # first a share of each language by the hash, somewhat more than wanted, then exactly the wanted number
    shares = F.create_map(*(F.lit(x) for l, n in sorted(sizes.items()) for x in (l, min(1.0, (1.5 * per_language + 50) / n))))
    some = rows.withColumn("o", F.xxhash64(F.lit("langid"), "id", "t")).where(F.pmod("o", F.lit(1 << 20)) < F.element_at(shares, F.col("l")) * (1 << 20))
    first = Window.partitionBy("l").orderBy("o", "t")
    got = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("l", "r", "t").collect()
    return [(r["t"], r["l"]) for r in sorted(got, key=lambda r: (r["l"], r["r"]))]


def predictions(auto: Scorer, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    if not auto.languages or not len(col):
        return [UNDETERMINED] * len(col), np.zeros(len(col))
    raw, off = tb.buffers(col)
    letters = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    bits = np.concatenate([auto.code_lengths(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in tb.blocks(off, 1 << 21)])
    score = 1.0 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
    lang = [auto.languages[i] if ok else UNDETERMINED for i, ok in zip(bits.argmin(1), letters, strict=True)]
    return lang, np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: PPMModel, id_cols: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``id_cols`` with lang_pred and score for each whole text; each row gives one row.

    score is the posterior of the chosen language under equal priors.  lang_pred is
    ``und`` with score 0 where the text is null or has no letter, or where the model
    has learned no language.  Ties go to the first language in alphabetical order.
    Null ids and repeated rows are kept as they are, an empty table gives no rows, and
    a very long text is scored whole, stretch by stretch.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = [f"c{i}" for i in range(len(id_cols))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = None
        for b in batches:
            if auto is None:
                auto = compiled(pickle.loads(blob.value))
            lang, score = predictions(auto, b.column(len(names)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = [docs.schema[c].dataType.simpleString() for c in id_cols]
    picked = docs.select(*(F.col(c).alias(n) for c, n in zip(id_cols, names, strict=True)), F.col(text_col).cast("string").alias("text"))
    out = picked.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", lang_pred string, score double")
    return out.withColumnsRenamed(dict(zip(names, id_cols, strict=True)))


def accepted(docs: DataFrame, model: PPMModel, least: float = 0.5, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with a posterior of at least ``least``.

    Null texts and texts without a letter go; each of the other rows is judged by
    its own text, whatever its id.  ``lang_col``: a string column whose nulls become
    the language predicted; a language that is there stays.
    """
    narrow_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    place = docs.columns.index(text_col)
    label = docs.columns.index(lang_col) if lang_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = None
        for b in batches:
            auto = auto or compiled(pickle.loads(blob.value))
            lang, score = predictions(auto, b.column(place))
            if label is not None:
                b = b.set_column(label, b.schema.field(label), pc.coalesce(b.column(label), pa.array(lang, b.column(label).type)))
            yield b.filter(pa.array(np.array([x != UNDETERMINED for x in lang], bool) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
