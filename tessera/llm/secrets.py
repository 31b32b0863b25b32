"""Secret scans: candidates by pattern, a random forest trained on labelled findings removes false positives."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: 16 characters or more of those that keys and encodings are made of.
RUN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Values of six characters or more of any kind are candidates too where a word for a secret is given them, and
#: so is what a URL has as its password, and a signed token with its dots.
CANDIDATE = re.compile(
    r"(?:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|credentials?)[\"']?[ \t]{0,3}(?:=|:(?!//))[ \t]{0,3}"
    rf"(?:\"(?P<double>[^\"\s]{{6,200}})\"|'(?P<single>[^'\s]{{6,200}})'|(?P<run>{RUN}(?![^\s\"'<>,;)\]}}*!]))|(?P<bare>[^\s\"'<>,;)\]}}]{{6,200}}))"
    r"|://[^\s:/@]{1,80}:(?P<url>[^\s/]{3,200})@(?=[\w\[])"
    r"|(?P<signed>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"
    rf"|(?P<plain>{RUN})",
    re.IGNORECASE,
)
#: Characters on either side that neighbouring words are looked for in.
AROUND = 40
#: Labelled findings that the default forest is trained on, and its size. Bounded, whatever is scanned.
FINDINGS, TREES, DEPTH, SEED = 4000, 24, 9, 11
#: Share of trees that call a candidate a secret from which it is one.
CUT = 0.5
MASK = "<SECRET>"

# Words that stand near secrets, words that stand near other long strings, beginnings of
# issued keys, and words whose presence inside a candidate speaks for a name rather than a key.
NEAR_SECRET = "token key secret password passwd pwd api apikey auth bearer credential credentials private access aws".split()
NEAR_OTHER = "commit sha sha1 sha256 md5 checksum digest etag uuid guid id revision hash card phone version file path url example sample test dummy placeholder".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "glpat-", "npm_")
NAMES = "the and for with from this that user name config test example default value image index file data time date page home main content static asset build module class method function service request response window event table column string number object list report summary version release document project manager controller internal external public license readme download upload archive backup message account address customer order product account".split()


@lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """Log probability of one letter after another in NAMES, add-one smoothed."""
    n = np.ones((26, 26))
    for w in NAMES:
        for a, b in zip(w, w[1:], strict=False):
            n[ord(a) - 97, ord(b) - 97] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


def candidates(text: str) -> list[tuple[int, int]]:
    """start, end of each candidate of a text, in order; none overlaps another."""
    return [m.span(m.lastgroup) for m in CANDIDATE.finditer(text)]


def features(before: str, candidate: str, after: str) -> list[float]:
    """Length, character classes and transitions, dictionary coverage, path and neighbouring words."""
    body = candidate.rstrip("=") or candidate
    n = len(body)
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]
    share = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    low = body.lower()
    steps = [transitions()[ord(a) - 97, ord(b) - 97] for a, b in zip(low, low[1:], strict=False) if "a" <= a <= "z" and "a" <= b <= "z"]
    covered = bytearray(n)
    for w in NAMES:
        at = low.find(w) if len(w) > 2 else -1
        while at >= 0:
            covered[at : at + len(w)] = b"\1" * len(w)
            at = low.find(w, at + 1)
    counts = np.array([body.count(c) for c in set(body)]) / n
    left = re.findall(r"[a-z0-9]+", before.lower())[-3:]
    right = re.findall(r"[a-z0-9]+", after.lower())[:2]
    tail = before.rstrip("\"' ")
    return [
        n,
        *share,
        changes,
        float(np.mean(steps)) if steps else -3.3,
        sum(covered) / n,
        float(-(counts * np.log2(counts)).sum()),
        float(all(c in "0123456789abcdef-" for c in low)),
        sum(c in "aeiou" for c in low) / n,
        float(candidate.startswith(PREFIXES)),
        body.count("/"),
        body.count("-") + body.count("_"),
        float(before.endswith(("/", ".", "\\", "@", "#")) or after.startswith(("/", ".", "@"))),
        float(tail.endswith(("=", ":"))),
        sum(w in NEAR_SECRET for w in left),
        sum(w in NEAR_OTHER for w in left + right),
    ]


@dataclass(frozen=True)
class Finding:
    before: str
    candidate: str
    after: str
    secret: bool


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[Finding]:
    """n findings with labels, drawn by a fixed seed: issued keys, hexadecimal and base64 tokens in
    assignments and prose, passwords in assignments and URLs on one side; on the other long words, names, paths,
    checksums, identifiers, card numbers, placeholders, and words, references and settings that are assigned."""
    r = random.Random(seed)
    hexa, alnum, upper = "0123456789abcdef", "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    draw = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllable = lambda: draw("bcdfghlmnprstvw", 1) + draw("aeiou", 1) + r.choice(["", "n", "r", "s", "th", "tion", "ing"])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 5)))
    out = []
    for _ in range(n):
        key = r.choice(NEAR_SECRET)
        assign = f'{r.choice([key, key.upper(), key + "_" + r.choice(NAMES)])}{r.choice([" = ", "=", ": ", " : "])}{r.choice(["", chr(34), chr(39)])}'
        kind = r.randrange(18)
        before, after, secret = prose() + " ", r.choice([" ", ". ", '" ', '"', "*** ", "!! ", "\n"]) + prose(), kind < 6 or kind in (14, 15)
        password = "".join(r.sample([word(), r.choice(NAMES).capitalize(), draw("0123456789", r.randint(1, 4)), draw("!@#$%^&*?.-_", r.randint(1, 2)), draw(alnum, r.randint(0, 6))], 5))
        if kind < 2:
            c = draw(hexa, r.choice([32, 40, 40, 40, 64]))
            c = c.upper() if r.random() < 0.15 else c
            before += assign
        elif kind == 2:
            c = "AKIA" + draw(upper, 16)
            before += r.choice(["", "", assign])
        elif kind == 3:
            p = r.choice(PREFIXES[2:])
            c = p + draw(alnum, r.randint(16, 40))
            before += r.choice(["", assign])
        elif kind in (4, 5):
            c = draw(alnum + "+/", r.randint(24, 60)) + r.choice(["", "=", "=="])
            before += assign
        elif kind < 8:
            c = ""
            while len(c) < 16:
                c += word()
            c = r.choice([c, c.capitalize(), c.upper()])
        elif kind == 8:
            c = draw("0123456789", r.choice([16, 16, 17, 19, 20]))
        elif kind == 9:
            c = "/".join(r.choice(NAMES) for _ in range(r.randint(4, 7)))
            before, after = before + r.choice(["/", "./", "https://" + r.choice(NAMES) + ".org/"]), r.choice([".html", ".py", "/", " "]) + prose()
        elif kind == 10:
            c = draw(hexa, r.choice([32, 40, 64]))
            before += r.choice(NEAR_OTHER[:8]) + r.choice([" ", ": ", "/", "="])
        elif kind == 11:
            c = "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12))
            before += r.choice(["", "id=", "uuid: ", "/"])
        elif kind == 12:
            c = r.choice("_-").join(r.choice(NAMES) for _ in range(r.randint(3, 6)))
            c = r.choice([c, c.upper()]) + r.choice(["", "_2", "-01"])
            before += r.choice(["", assign])
        elif kind == 14:
            c = r.choice([password, password, draw(alnum, r.randint(8, 15)), draw(hexa, r.randint(10, 15))])
            before += assign
        elif kind == 15:
            c = r.choice([password, draw(alnum, r.randint(8, 20))])
            before += r.choice(["postgres", "mysql", "https", "amqp", "redis"]) + "://" + r.choice(NAMES) + ":"
            after = "@" + r.choice([word() + ".org", "localhost", "10.0.0.1"]) + r.choice(["", ":5432", "/main"])
        elif kind == 16:
            c = r.choice([word() + word(), word() + word() + r.choice([".", ",", ""]), r.choice(NAMES) + "_" + r.choice(NAMES), r.choice(NAMES) + r.choice(NAMES).capitalize() + "()"])
            before += assign.rstrip("\"'") if r.random() < 0.7 else assign
        elif kind == 17:
            c = r.choice(["${" + r.choice(NAMES).upper() + "_" + key.upper() + "}", "os.environ[" + r.choice(NAMES), "changeme", "password", "required", "optional", "<your-" + key, "********", "undefined", "my_" + key, "{{" + r.choice(NAMES) + "}}", "$" + r.choice(NAMES).upper(), "process.env." + r.choice(NAMES).upper()])
            before += assign
        else:
            c = r.choice(["x" * r.randint(16, 40), "your_" + key + "_goes_here", "0" * r.randint(16, 40), "EXAMPLE" + key.upper() + "PLACEHOLDER", "-" * r.randint(16, 60), "=" * 3 + "_" * r.randint(16, 30)])
            before += assign
        whole = before + c + after
        at = next((x for x in candidates(whole) if len(before) <= x[0] < len(before) + len(c)), None)
        if at:
            out.append(Finding(whole[max(0, at[0] - AROUND) : at[0]], whole[at[0] : at[1]], whole[at[1] : at[1] + AROUND], secret))
    return out


class Forest:
    """Binary classification trees on bootstrap samples; each split tries a random third of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x)) if len(x) else np.zeros(0, dtype=int)
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me, share = len(nodes), float(y.mean()) if len(y) else 0.0
        nodes.append((-1, 0.0, me, me, share))
        if depth and len(y) >= 8 and 0 < share < 1:
            best = (share * (1 - share) - 1e-9, None, 0.0)
            for f in rng.permutation(x.shape[1])[: max(1, x.shape[1] // 3)]:
                values = np.unique(x[:, f])
                if len(values) < 2:
                    continue
                middles = (values[1:] + values[:-1]) / 2
                for cut in middles if len(middles) <= 16 else np.quantile(middles, np.linspace(0.03, 0.97, 16)):
                    left = x[:, f] <= cut
                    k = left.mean()
                    if 0 < k < 1:
                        p, q = y[left].mean(), y[~left].mean()
                        impurity = k * p * (1 - p) + (1 - k) * q * (1 - q)
                        if impurity < best[0]:
                            best = (impurity, f, float(cut))
            if best[1] is not None:
                left = x[:, best[1]] <= best[2]
                a = self._grow(x[left], y[left], depth - 1, rng, nodes)
                b = self._grow(x[~left], y[~left], depth - 1, rng, nodes)
                nodes[me] = (int(best[1]), best[2], a, b, share)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row falls into."""
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (feature[at] >= 0).any():
                f = feature[at]
                down = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
                at = np.where(f >= 0, down, at)
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: Sequence[Finding]) -> Forest:
    x = np.array([features(f.before, f.candidate, f.after) for f in findings], dtype=float)
    return Forest(x.reshape(len(findings), -1), np.array([f.secret for f in findings], dtype=float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return train(labelled_findings())


def scan(texts: Sequence[str | None], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """start, end (code points) and score of each candidate of each text."""
    spots, rows = [], []
    for i, text in enumerate(texts):
        for a, b in candidates(text or ""):
            spots.append((i, a, b))
            rows.append(features(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    scores = forest.predict(np.array(rows, dtype=float)) if rows else []
    for (i, a, b), s in zip(spots, scores, strict=True):
        out[i].append((a, b, round(float(s), 9)))
    return out


def masked(text: str | None, found: list[tuple[int, int, float]], cut: float = CUT) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for a, b, s in found:
        if s >= cut:
            parts += [text[at:a], MASK]
            at = b
    return "".join([*parts, text[at:]])


def secret_scan(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, n_candidates, n_secrets (long), secrets (array of start, end, score; code
    points), masked_sha256 (of the text with each secret replaced by MASK).

    forest: of train(); by default one trained on labelled_findings(). Null text is as empty: nothing
    found, the digest of the empty string. Rows are taken one by one: repeated rows, ties and null ids
    keep a row each; other columns are ignored. An empty table gives an empty result. Whole texts are read.
    """
    bounded_batches(docs.sparkSession)
    forest = forest or default_forest()
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = scan(texts, forest)
            secrets = [[dict(zip(("start", "end", "score"), x, strict=True)) for x in f if x[2] >= cut] for f in found]
            clean = [hashlib.sha256((masked(t, f, cut) or "").encode("utf-8", "surrogatepass")).hexdigest() for t, f in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([len(s) for s in secrets], pa.int64()),
                    pa.array(secrets, pa.list_(spot)),
                    pa.array(clean, pa.string()),
                ],
                names=["doc_id", "n_candidates", "n_secrets", "secrets", "masked_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run,
        "doc_id long, n_candidates long, n_secrets long, secrets array<struct<start: long, end: long, score: double>>, masked_sha256 string",
    )


def mask_secrets(docs: DataFrame, forest: Forest | None = None, cut: float = CUT) -> DataFrame:
    """docs with each secret in text replaced by MASK, and n_chars, where there is one, counted anew.

    Null texts, empty ones and null n_chars stay as they are. Rows are taken one by one, so repeated rows and null ids
    stay too, and so do all other columns, whatever their names. An empty table gives an empty one."""
    bounded_batches(docs.sparkSession)
    forest = forest or default_forest()
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            clean = [masked(t, f, cut) for t, f in zip(texts, scan(texts, forest), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(clean, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)],
                names=schema.names,
            )

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind)))
    return out.select(*docs.columns)
