"""Token counts and token ids by pre-token.

A pre-token's pieces don't depend on its neighbours.  To count, the pieces of each
distinct pre-token of the corpus are counted once, in a table; that is joined to
the pre-tokens of each document.  The join has two parts, which together are whole:
the most frequent pre-tokens, a bounded number, go to every worker and are joined
inside the task; all others are joined through a shuffle.  So a hot pre-token is
never shuffled, and what is broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm.store import settled

#: fixed values: the pre-token patterns of the two public vocabularies
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: entries of a worker's table of pre-tokens; it is emptied when full
TABLE_LIMIT = 400_000
#: the key of a longer pre-token is its digest, so that no long string goes through a join
KEEP_CHARS = 48
#: distinct pre-tokens, and their characters, that a task holds before it hands them on; rows of a batch of them
TALLY_LIMIT, TALLY_CHARS, TALLY_ROWS = 100_000, 4_000_000, 10_000
#: longer texts aren't split into a list
LIST_CHARS = 200_000
#: pre-tokens that go to every worker at most
HEAD_LIMIT = 100_000

_plain = re.compile(r"[^\x00-\u02ff]")
_made: dict = {}


def _latin(pattern: str) -> re.Pattern:
    """``pattern`` for texts below U+0300, its Unicode classes written out."""

    def members(cls: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x300) if regex.match(cls, chr(c)))

    letters, numbers, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _model_pieces(model, token: str) -> list:
    return model.tokenize(token.encode().decode("latin-1").translate(_LETTERS))


_LETTERS = _byte_letters()


class IdTable(dict):
    """Pre-token -> its ids as bytes, found on first use."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, token: str) -> bytes:
        got = _packed([t.id for t in _model_pieces(self.model, token)])
        if len(token) <= KEEP_CHARS:
            if len(self) >= TABLE_LIMIT:
                self.clear()
            self[token] = got
        return got


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _load(path: str):
    """Tokenizer, its pattern, whether it lowers case, a pattern of its special strings and a table of ids, once per worker."""
    if path not in _made:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = tok.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError(f"{path}: special strings that take in their surroundings aren't supported")
        # the library takes the leftmost and there the longest
        special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or "(?!)")
        lower = tok.normalizer is not None
        # below U+0300 the pattern and the library agree on every character; other texts are split by the library
        pattern = _latin(WORD_PATTERN if lower else BYTE_PATTERN)
        _made[path] = tok, pattern, lower, special, IdTable(tok.model)
    return _made[path]


def frequencies(text: str, path: str) -> tuple[Counter, int]:
    """How often each pre-token occurs, and how many special strings stand between them.

    A special string is a token of its own, and the text is split there first.
    """
    tok, pattern, lower, special, _ = _load(path)
    parts = special.split(text) if special.search(text) else [text]
    seen: Counter = Counter()
    for part in parts:
        if not _plain.search(part):
            part = part.lower() if lower else part
            # a long text's pre-tokens aren't listed: the list would be many times its size
            seen.update(pattern.findall(part) if len(part) <= LIST_CHARS else (m.group() for m in pattern.finditer(part)))
        else:
            if tok.normalizer is not None:
                part = tok.normalizer.normalize_str(part)
            seen.update(part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part))
    return seen, len(parts) - 1


def key_of(token: str) -> str:
    """The pre-token itself, or a digest of a long one (which no pre-token is: it begins with a NUL and a letter)."""
    return token if len(token) <= KEEP_CHARS else "\0d" + hashlib.sha256(token.encode()).hexdigest()


def id_bytes(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers."""
    tok, pattern, lower, special, table = _load(path)
    if _plain.search(text) or special.search(text):
        return _packed(tok.encode(text, add_special_tokens=False).ids)
    return b"".join(map(table.__getitem__, pattern.findall(text.lower() if lower else text)))


def piece_counts(texts: DataFrame, path: str) -> DataFrame:
    """token, n, pieces: the key of every distinct pre-token of column t, how often it occurs, its pieces."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            # long ones last, in batches of their own
            items = iter(sorted(seen.items(), key=lambda x: len(x[0]) > KEEP_CHARS) if size else seen.items())
            while part := list(islice(items, TALLY_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["token", "n"])
            seen.clear()

        seen: Counter = Counter()
        size = 0
        for b in batches:
            for text in b.column(0):
                got, _ = frequencies(text.as_py() or "", path)
                seen.update(got)
                size += sum(len(t) for t in got if len(t) > KEEP_CHARS)
                if len(seen) >= TALLY_LIMIT or size >= TALLY_CHARS:
                    yield from flush()
                    size = 0
        yield from flush()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = _load(path)[0].model
            found = b.column(0).to_pylist()
            n = [len(_model_pieces(model, t)) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(t) for t in found], pa.string()), b.column(1), pa.array(n, pa.int64())], names=["token", "n", "pieces"])

    tallies = texts.select("t").mapInArrow(tally, "token string, n long")
    return settled(tallies.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(pieces, "token string, n long, pieces long"), "pieces")


def head(pieces: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens: all above the lowest frequency class with which they stay at most ``most``."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, most
    for r in sorted(pieces.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return {}
    got = pieces.where(step >= least).select("token", "pieces").toArrow()
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", most: int = HEAD_LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text, as the library's ``encode(text, add_special_tokens=False)`` counts.

    Columns: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit).  A null
    text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are each
    counted; an empty table gives no rows; only the two named columns are read, so
    extra columns cannot clash.  A special string counts as one token and parts the
    text; a pre-token of any length is counted once, a long one under its digest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    pieces = piece_counts(picked, path)
    shared = docs.sparkSession.sparkContext.broadcast(head(pieces, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in batches:
            sizes, known, ends, rare, often = [], [], [0], [], []
            for value in b.column(1):
                text = value.as_py() or ""
                found, total = frequencies(text, path)
                for token, f in found.items():
                    token = token if len(token) <= KEEP_CHARS else key_of(token)
                    n = common.get(token)
                    if n is not None:
                        total += n * f
                    else:
                        rare.append(token)
                        often.append(f)
                sizes.append(len(text.encode()))
                known.append(total)
                ends.append(len(rare))
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(often, pa.int64())], names=["token", "f"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), rest], names=["id", "n_bytes", "known", "rest"])

    split = picked.mapInArrow(run, f"id {kind}, n_bytes long, known long, rest array<struct<token: string, f: long>>")
    split = settled(split.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    # only the row number goes with a rare pre-token; the other columns meet its sum once per document
    rare = split.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.f")
    sums = rare.join(pieces.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("f") * F.col("pieces")).alias("more"))
    both = split.select("row", "id", "n_bytes", "known").join(sums, "row", "left").withColumn("n_tokens", F.col("known") + F.coalesce("more", F.lit(0)))
    return both.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and ``end_id``, cut into pieces of at most ``capacity`` ids.

    Columns: ``id_col``, piece, start, length, ids_crc32 and, if asked for, ids
    (binary, little-endian unsigned 32-bit).  A null or empty text is the single
    id ``end_id``.
    """
    tail, width = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = id_bytes(text or "", path) + tail
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    for out, x in zip(rows, (at, k // width, k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        out.append(x)
            arrays = [pa.array(rows[0], b.column(0).type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[5], pa.binary())] * with_ids, names=["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
