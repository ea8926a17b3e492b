"""Secret scanning: pattern candidates, false positives removed by a random forest.

Candidates are strings that look like credentials.  Each is described by its length
and character make-up, its character transitions (under letter-pair probabilities
learned from the corpus), how much of it the corpus's own frequent words cover,
whether it sits in a path, and its neighbouring words; a forest grown in numpy on
labelled findings tells secrets from the rest.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypnoframe.llm import textblocks as tb
from hypnoframe.llm.store import settled
from hypnoframe.llm.tokens import head

#: fixed values: prefixes that issuers put before their keys
ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{24,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
#: fixed values: names to which secrets are assigned
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "private_key", "credential", "bearer")
#: fixed values: words beside harmless look-alikes
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "revision", "version", "build", "etag", "isbn", "order", "invoice", "example", "sample", "dummy", "placeholder", "blob", "image", "png", "card", "phone", "tel")
#: fixed values: values that documentation puts where a secret goes
STAND_INS = ("changeme", "password", "your_token_here", "example123", "xxxxxxxxxxxx", "<password>", "default", "None", "required", "insert-key-here", "secret-name", "placeholder")
#: fixed values: url schemes in which a password may stand before the host
SCHEMES = "postgres(?:ql)?|mysql|mariadb|mongodb(?:[+]srv)?|redis|amqps?|ftps?|sftp|https?|ssh|smtps?|ldaps?"
#: the dictionary's words at most, and the letters of one at least
MOST_WORDS, WORD_CHARS = 20_000, 3

CANDIDATE = re.compile(
    rf"(?P<pem>-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?)"
    rf"|\b(?:{SCHEMES})://[^\s/:@\"'<>]++:(?P<dsn>[^\s/@\"'<>]++)(?=@)"
    rf"|(?P<issued>\b(?:{ISSUED})(?:\b|(?<=-)(?![\w-])))"
    rf"|(?i:(?P<name>\b[\w-]*(?:{'|'.join(NAMES)})[\w-]*)[\"']?\s{{0,3}}(?:[:=]|\s)\s{{0,3}}[\"']?)(?P<value>[^\s\"'<>,;]{{6,}}+)"
    r"|(?P<random>(?<![\w/+=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+(?![\w/+=-]))"
)
GROUPS = ("pem", "dsn", "issued", "value", "random")
#: a text without one of these has no candidate; found faster than candidates are
HINT = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|\d|-----BEGIN|://|(?i:" + "|".join(NAMES) + ")")
FEATURES = ("length", "digits", "uppers", "lowers", "others", "entropy", "switches", "letter_run", "transitions", "covered", "hex", "issued", "assigned", "secret_words", "harmless_words", "path", "extension", "repeats", "quoted", "dashes")


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    rule: str


@dataclass
class Lexicon:
    """What the corpus says about ordinary text: its frequent words, and letter pairs' log2 probabilities (26 by 26)."""

    words: list[str] = field(default_factory=list)
    pairs: np.ndarray = field(default_factory=lambda: np.full((26, 26), -math.log2(26)))

    def __post_init__(self):
        self.known = frozenset(self.words)
        self.longest = max(map(len, self.words), default=0)

    def covered(self, low: str) -> float:
        """Share of a lower-case string that words cover."""
        hit = np.zeros(len(low), bool)
        for i in range(len(low)):
            for k in range(min(self.longest, len(low) - i), WORD_CHARS - 1, -1):
                if low[i : i + k] in self.known:
                    hit[i : i + k] = True
                    break
        return float(hit.mean()) if len(low) else 0.0

    def transitions(self, low: str) -> float:
        """Mean log2 probability of the steps from letter to letter; a step to or from a digit counts as -8."""
        total, n = 0.0, 0
        for a, b in zip(low, low[1:], strict=False):
            if "a" <= a <= "z" and "a" <= b <= "z":
                total, n = total + self.pairs[ord(a) - 97, ord(b) - 97], n + 1
            elif a.isdigit() != b.isdigit():
                total, n = total - 8.0, n + 1
        return total / n if n else 0.0


def learn(docs: DataFrame, most: int = MOST_WORDS, text_col: str = "text") -> Lexicon:
    """Words and letter pairs of all whole texts.

    Both are counted within tasks first and then added up by Spark; what reaches the
    driver is the letter pairs and the most frequent words, ``most`` of them at most.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = [*seen, *(f"\0{i}" for i in np.flatnonzero(pairs))]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*seen.values(), *pairs[pairs > 0].tolist()], pa.int64())], names=["token", "n"])

        seen: Counter = Counter()
        pairs = np.zeros(676, np.int64)
        for b in batches:
            raw, off = tb.buffers(tb.lowered(b.column(0)))
            for x, y in tb.blocks(off):
                part = raw[off[x] : off[y]]
                letter = (part >= 97) & (part <= 122)
                step = letter[:-1] & letter[1:]
                border = off[x + 1 : y] - off[x] - 1  # the last byte of a row is followed by another row's first
                step[border[(border >= 0) & (border < len(step))]] = False
                both = np.flatnonzero(step)
                pairs += np.bincount((part[both].astype(np.int64) - 97) * 26 + part[both + 1] - 97, minlength=676)
                _, start, end, h = tb.words(part, off[x : y + 1] - off[x], tb.NON_ALNUM)
                _, first, count = np.unique(h, return_index=True, return_counts=True)
                data = part.tobytes()
                for a, z, n in zip(start[first].tolist(), end[first].tolist(), count.tolist(), strict=True):
                    if WORD_CHARS <= z - a <= 64 and (word := data[a:z].decode("utf-8", "replace")).isalpha():
                        seen[word] += n
            if len(seen) >= 100_000:
                yield out()
                seen.clear()
                pairs[:] = 0
        yield out()

    picked = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
    counts = settled(picked.mapInArrow(tally, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "lexicon")
    steps = np.ones((26, 26))
    for r in counts.where(F.col("token").startswith("\0")).collect():
        steps[divmod(int(r["token"][1:]), 26)] += r["n"]
    words = head(counts.where(~F.col("token").startswith("\0")).withColumn("pieces", F.lit(0)), most)
    return Lexicon(sorted(words), np.log2(steps / steps.sum(1, keepdims=True)))


def candidates(text: str) -> list[Finding]:
    """Candidates of a text from left to right, without overlap."""
    if not HINT.search(text):
        return []
    out = []
    for m in CANDIDATE.finditer(text):
        group = next(g for g in GROUPS if m[g])
        a, b = m.span(group)
        while group == "value" and b > a + 6 and text[b - 1] in ".)]}":
            b -= 1
        while group == "pem" and text[b - 1].isspace():
            b -= 1
        out.append(Finding(a, b, group))
    return out


def describe(text: str, f: Finding, lexicon: Lexicon) -> list[float]:
    """Numbers of FEATURES for a candidate within its text."""
    s = text[f.start : f.end]
    n = len(s)
    count = Counter(s)
    before, after = text[max(0, f.start - 48) : f.start], text[f.end : f.end + 32]
    near = set(re.findall(r"[a-z_][a-z0-9_]*", before.lower())[-4:])
    near |= {p for w in near for p in w.split("_")}
    beyond = set(re.findall(r"[a-z]+", after.lower())[:2])
    low = s.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    return [
        float(min(n, 128)),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("l") / n,
        kinds.count("o") / n,
        -sum(c / n * math.log2(c / n) for c in count.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        max((len(x) for x in re.findall(r"[a-zA-Z]+", s)), default=0) / n,
        lexicon.transitions(low[:256]),
        lexicon.covered(low[:256]),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        float(f.rule in ("issued", "pem", "dsn")),
        float(f.rule == "value" and bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(bool(near & set(NAMES) or near & {"key", "api", "bearer", "credentials"})),
        float(bool((near | beyond) & set(HARMLESS))),
        float("/" in s or before[-1:] == "/" or "://" in before[-24:]),
        float(bool(re.search(r"\.(?:png|jpe?g|gif|css|js|html?|py|txt|json|com|org|net)\b", s + after[:6]))),
        max(count.values()) / n,
        float(before[-1:] in "\"'" and before[-1:] != ""),
        s.count("-") / n,
    ]


def sample(docs: DataFrame, most: int = 400, most_chars: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Texts with digits to take contexts and look-alikes from, chosen by a hash: at most ``most``, each of at most ``most_chars`` characters.

    Only the share of rows that gives about as many reaches the driver.
    """
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike("[0-9]{6}") & (F.length("t") <= most_chars))
    order = F.pmod(F.xxhash64(F.lit("secrets"), "id", "t"), F.lit(1 << 30))
    share = min(1.0, 1.2 * most / max(t.count(), 1))
    some = t.where(order <= int(share * (1 << 30))).select(order.alias("o"), "t").distinct()
    return [x for _, x in sorted((r["o"], r["t"]) for r in some.collect())[:most]]


def labelled_findings(n: int = 3000, seed: int = 11, lexicon: Lexicon | None = None, texts: list[str] = ()) -> tuple[list[tuple[str, Finding]], list[int]]:
    """Labelled findings to learn from: texts around a value that is a secret (1) or only looks like one (0).

    There are no labelled findings in the tables.  Secrets are made by the formats in
    which they are issued and chosen; what only looks like one is made from the
    corpus's words and from formats of other things, and the numbers of ``texts``
    (candidates of digits alone, under no name that asks for a secret) are taken as
    they stand.  The words around come from ``texts``, else from the lexicon.
    """
    r = random.Random(seed)
    hexa, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    caps, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789"
    draw = lambda a, k: "".join(r.choice(a) for _ in range(k))
    stock = [w for w in (lexicon.words if lexicon else ()) if w.isascii()] or [draw("abdehilmnorstuv", r.randint(3, 9)) for _ in range(300)]
    word = lambda: r.choice(stock)

    def prose(k: int) -> str:
        if texts and r.random() < 0.7:
            w = r.choice(texts).split()
            a = r.randrange(max(1, len(w) - k))
            return " ".join(x for x in w[a : a + k] if not re.search(r"\d{4}", x)) or word()
        return " ".join(word() for _ in range(k))

    def secret() -> tuple[str, str, str]:
        kind = r.randrange(11)
        name = r.choice(NAMES[:-1])
        name = r.choice((name, name, name.upper(), name.capitalize(), f"{word()}_{name}"))
        if kind == 0:
            return r.choice(("", "key ", "aws ", word() + " ")), "AKIA" + draw(caps, 16), ""
        if kind == 1:
            q = r.choice(('"', "'"))
            value = draw(hexa, r.choice((16, 32, 40, 64)))
            return f"{name} {r.choice('=:')} {q}", r.choice((value, value.upper())), q
        if kind == 2:
            return f"{name}{r.choice('=:')}", draw(hexa, r.choice((12, 16, 20, 24, 32))), ""
        if kind == 3:
            return f"{name}{r.choice(('=', ': ', ' = '))}", draw(base, r.randint(16, 48)), ""
        if kind == 4:
            return r.choice(("", "token ", word() + " ")), r.choice(("ghp_", "gho_")) + draw(base, 36), ""
        if kind == 5:
            return f"{name}=", word()[:5] + draw("!#%&*_-", 1) + draw(base, r.randint(8, 12)), ""
        if kind == 6:
            return r.choice(("key ", "stripe ", "")), "sk_live_" + draw(base, 24), ""
        if kind == 7:
            return r.choice(("bearer ", "Bearer ", "auth: ")), "eyJ" + draw(base, 20) + "." + draw(base, 40) + "." + draw(base, 43), ""
        if kind == 8:  # chosen by people
            return f"{r.choice(('password', 'passwd', 'pwd', 'Password', 'my password'))}{r.choice((': ', '=', ' = '))}", word()[:6] + draw(digits, r.randint(1, 4)) + r.choice(("", "!", word()[:6])), r.choice(("", "."))
        if kind == 9:
            return f"{r.choice(('postgres', 'mysql', 'mongodb', 'redis', 'amqp'))}://{word()}:", r.choice((word()[:4].capitalize() + draw(base, r.randint(4, 12)), draw(base, 16))), f"@{word()}:5432/{word()}"
        body = "\n".join(draw(base + "+/", 64) for _ in range(r.randint(2, 6)))
        return "", f"-----BEGIN {r.choice(('RSA ', 'EC ', ''))}PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----", ""

    def harmless() -> tuple[str, str, str]:
        kind = r.randrange(12)
        if kind == 0:
            return f"{r.choice(('commit', 'sha1', 'md5', 'checksum', 'revision', 'digest'))}{r.choice((' ', ': ', '='))}", draw(hexa, r.choice((16, 32, 40, 64))), ""
        if kind == 1:
            return r.choice(("uuid ", "id ", "guid=", word() + " ")), "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), ""
        if kind == 2:
            return f"{r.choice(NAMES)}{r.choice(('=', ': ', ' '))}", r.choice(STAND_INS), ""
        if kind == 3:
            return f"{r.choice(NAMES)}{r.choice((' ', ' ', ': '))}", word() + word(), r.choice((".", ",", ""))
        if kind == 4:
            return r.choice(("https://", "http://")) + word() + ".example.com/", "-".join(word() for _ in range(4)) + "-" + draw(digits, 4), r.choice((".html", "/", ""))
        if kind == 5:
            return r.choice(("card ", "order ", "tel ", word() + " ")), draw(digits, r.choice((16, 18, 20))) + r.choice(("", "x")), ""
        if kind == 6:
            return "/usr/lib/" if r.random() < 0.5 else "src/", "/".join(word() + word() for _ in range(3)) + draw(digits, 1), r.choice((".py", ".js", ""))
        if kind == 7:
            return "", "".join(word() for _ in range(r.randint(3, 5))) + draw(digits, 1), ""
        if kind == 8:
            return "data:image/png;base64,", "iVBORw0KGgo" + draw(base + "+/", r.randint(40, 120)), ""
        if kind == 9:
            return "", "_".join(word() for _ in range(4)) + "_v" + draw(digits, 2), ""
        if kind == 10:
            return f"{r.choice(NAMES)} ", r.choice((word() + draw("aeiou", 2) + word(), word() + "-" + word())), r.choice((".", ",", ""))
        return word() + " ", "-".join(("2024", f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}T{r.randint(10, 23)}")) + draw(digits, 6), ""

    rows, labels = [], []
    for i in range(n):
        label = i % 2
        a, value, z = secret() if label else harmless()
        before = prose(r.randint(2, 8)) + " " + a
        text = before + value + z + " " + prose(r.randint(2, 8))
        at = len(before)
        rule = next((f.rule for f in candidates(text) if f.start <= at < f.end), "random")
        rows.append((text, Finding(at, at + len(value), rule)))
        labels.append(label)
    for t in texts:
        numbers = [f for f in candidates(t) if f.rule == "random" and t[f.start : f.end].isdigit()][:3]
        rows += [(t, f) for f in numbers]
        labels += [0] * len(numbers)
    return rows, labels


class Forest:
    """Decision trees on bootstrap samples, each split chosen among a few random features by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.grown: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        tries = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(self.trees):
            nodes: list[tuple] = []
            self._grow(x, y, rng.integers(0, len(y), len(y)), 0, tries, rng, nodes)
            self.grown.append(nodes)
        return self

    def _grow(self, x, y, rows, level, tries, rng, nodes) -> int:
        at = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        if level >= self.depth or len(rows) < 2 * self.least or share in (0.0, 1.0):
            return at
        best = (share * (1 - share) * len(rows) - 1e-9, None)
        for f in rng.choice(x.shape[1], tries, replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 13))):
                left = v <= cut
                n = int(left.sum())
                if self.least <= n <= len(rows) - self.least:
                    a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                    cost = a * (1 - a) * n + b * (1 - b) * (len(rows) - n)
                    if cost < best[0]:
                        best = (cost, (int(f), float(cut)))
        if best[1]:
            f, cut = best[1]
            left = x[rows, f] <= cut
            i = self._grow(x, y, rows[left], level + 1, tries, rng, nodes)
            j = self._grow(x, y, rows[~left], level + 1, tries, rng, nodes)
            nodes[at] = (f, cut, i, j, share)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.grown:
            f, cut, i, j, share = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                go = np.flatnonzero(inner)
                k = at[go]
                at[go] = np.where(x[go, f[k]] <= cut[k], i[k], j[k])
            total += share[at]
        return total / max(1, len(self.grown))


@dataclass
class Scanner:
    """A forest and the lexicon by which its candidates are described."""

    forest: Forest
    lexicon: Lexicon

    def scores(self, rows: list[tuple[str, Finding]]) -> np.ndarray:
        return self.forest.predict(np.array([describe(t, f, self.lexicon) for t, f in rows])) if rows else np.zeros(0)

    def judged(self, text: str) -> list[tuple[Finding, float]]:
        found = candidates(text)
        return list(zip(found, self.scores([(text, f) for f in found]).tolist(), strict=True))


def train(rows: list[tuple[str, Finding]] | None = None, labels: list[int] | None = None, lexicon: Lexicon | None = None) -> Scanner:
    """A scanner from labelled findings; without any, from ``labelled_findings()``."""
    lexicon = lexicon or Lexicon()
    if rows is None:
        rows, labels = labelled_findings(lexicon=lexicon)
    return Scanner(Forest().fit(np.array([describe(t, f, lexicon) for t, f in rows]), np.array(labels, float)), lexicon)


def trained_on(docs: DataFrame) -> Scanner:
    """A scanner whose lexicon is all of ``docs``, and whose findings stand in texts of a bounded sample of it."""
    lexicon = learn(docs)
    return train(*labelled_findings(lexicon=lexicon, texts=sample(docs)), lexicon)


def scan(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate of every whole text: id, start, end (code points), rule, value, score, is_secret.

    Candidates don't overlap: at one place the first of the patterns pem, dsn, issued,
    value, random wins, and each runs to its end, whatever its length (only the
    first 256 characters of one enter the dictionary and transition features).
    Null and empty texts have no candidate, and an empty table gives no rows;
    repeated rows and null ids are each scanned; other columns aren't read.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or pickle.loads(blob.value)
            rows = [(k, f.start, f.end, f.rule, t[f.start : f.end], s) for k, t in enumerate(b.column(1).to_pylist()) if t for f, s in own.judged(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            score = np.array(cols[5], float)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_())],
                names=["id", "start", "end", "rule", "value", "score", "is_secret"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(run, f"id {kind}, start long, end long, rule string, value string, score double, is_secret boolean").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, scanner: Scanner, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; ``chars_col``, if there, follows the new text.

    A secret is replaced whole, to its last character.  Rows without one, null texts
    included, stay as they are; repeated rows are each treated alike; every row and
    column comes back, in its order.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(scanner))
    place = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            own = own or pickle.loads(blob.value)
            texts = b.column(place).to_pylist()
            sizes = b.column(chars).to_pylist() if chars is not None else None
            changed = False
            for k, t in enumerate(texts):
                for f, s in reversed(own.judged(t) if t else []):
                    if s >= threshold:
                        texts[k] = texts[k][: f.start] + mark + texts[k][f.end :]
                        changed = True
                if sizes is not None and texts[k] is not t:
                    sizes[k] = len(texts[k])
            if changed:
                cols = list(b.columns)
                cols[place] = pa.array(texts, cols[place].type)
                if chars is not None:
                    cols[chars] = pa.array(sizes, cols[chars].type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
