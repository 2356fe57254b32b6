"""Secret scanning with a random forest that removes false positives.

Candidates are found in whole texts and at any length: known key formats, values assigned to a name (quoted,
unquoted, in JSON, phrases of a credential's name), authorization headers, passwords inside addresses, and long bare
tokens. Each gets features of its length, alphabet, entropy, character transitions, coverage by dictionary
words, the name and the path it stands under, and the NEIGHBOURS words on either side. The forest is trained on labelled findings: those
given as ``findings`` (doc_id, start, label 0/1; at most about TRAIN_FINDINGS of each class, drawn by a hash), else
TRAIN_FINDINGS of ``findings.labelled``, which are written apart from these features.

Secrets are reported by place, length and SHA-256, never in clear. Nulls: a null text holds nothing;
a null doc_id or source is kept as it is. Repeated rows give repeated findings. With given findings of one
class alone every candidate scores the share of label 1 (0.5 without any). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.findings import WORDS, labelled
from spendlight.llm.tables import share, table
from spendlight.storage import cut

TRAIN_FINDINGS, TREES, DEPTH, LEAST_LEAF = 4000, 25, 9, 3
#: Words on either side of a candidate that are looked at.
NEIGHBOURS = 6

# fixed values: key formats, words of credentials, words of what only looks like one
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[0-9A-Za-z]{36,}\b",
    "slack": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "jwt": r"\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----)?",
    "address": r"(?<![\w+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s:/@]++:([^\s@/]{6,}+)@",
    "assigned": r"(?<![\w.-])([A-Za-z_][\w.-]*+)[\"']?\s{0,3}[=:]\s{0,3}(?:\"([^\"\n]{6,}+)\"|'([^'\n]{6,}+)')",
    "bare": r"(?<![\w/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[0-9A-Za-z_/+-]{20,}+(?![\w/+-])",
}
SECRET_WORDS = "api auth bearer credential key pass passwd password private pwd secret session token".split()
DOUBT_WORDS = "build checksum commit demo digest docs dummy etag example examples fake fingerprint fixture hash id md5 object request revision sample sha sha1 sha256 test tests trace uuid version".split()
DICTIONARY = sorted({w for w in "abc admin change changeme default demo dummy example foo bar hello insert key main master name none not null pass password placeholder please public qwerty real redacted required sample secret string test token user value version world your here".split()} | set(WORDS))

_FIND = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in FORMATS.items()))
#: Looked for beside the others, so that these are found inside them too.
_UNQUOTED = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)[ \t]{0,3}[=:][ \t]{0,3}(?!//)([^\s\"']{6,}+)")
_HEADER = re.compile(r"(?i)(?<![\w-])(?:proxy-)?authorization[\"']?[ \t]{0,3}:[ \t]{0,3}[\"']?(?:bearer|basic|token)[ \t]+([\w+/=.~-]{6,}+)")
_WORD, _DICTIONARY = re.compile(r"[A-Za-z0-9]+"), re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
KINDS = [*FORMATS, "header", "unquoted"]
NAMES = ("kind", "length", "entropy", "digits", "upper", "lower", "other", "hex", "transitions", "runs", "dictionary", "secret_near", "doubt_near", "secret_name", "doubt_name", "path", "vowels", "parts", "distinct")


def _is_credential(name: str) -> bool:
    return any(w in name for w in SECRET_WORDS)


def find(text: str | None):
    """``(start, value, kind, name)`` of every candidate, each place once.

    A value under eight signs or with blanks inside counts only under the name of a credential.
    """
    text, starts = text or "", set()
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        # named groups hold numbered ones: lastgroup is the alternative that matched
        at, name = m.re.groupindex[kind], ""
        if kind == "assigned":
            name = m[at + 1].lower()
            group = at + 2 if m[at + 2] is not None else at + 3
        else:
            group = at + 1 if kind == "address" else at
        value = m[group]
        if kind != "assigned" or _is_credential(name) or (len(value) >= 8 and not any(c.isspace() for c in value)):
            starts.add(m.start(group))
            yield m.start(group), value, kind, name
    for m in _HEADER.finditer(text):
        if m.start(1) not in starts:
            starts.add(m.start(1))
            yield m.start(1), m[1], "header", "authorization"
    for m in _UNQUOTED.finditer(text):
        name = m[1].lower()
        scheme = name.endswith("authorization") and m[2].lower() in ("bearer", "basic", "token")
        if m.start(2) not in starts and not scheme and (len(m[2]) >= 8 or _is_credential(name)):
            yield m.start(2), m[2], "unquoted", name


def around(text: str, start: int, end: int, words: int = NEIGHBOURS) -> str:
    """The words on either side of a place, whole."""
    low = start
    for _ in range(words):
        while low > 0 and text[low - 1].isspace():
            low -= 1
        while low > 0 and not text[low - 1].isspace():
            low -= 1
    high, n = end, len(text)
    for _ in range(words):
        while high < n and text[high].isspace():
            high += 1
        while high < n and not text[high].isspace():
            high += 1
    return f"{text[low:start]} {text[end:high]}"


def _kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, kind: str, name: str, near: str, source: str | None) -> list[float]:
    n = len(value)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [_kind_of(c) for c in value]
    lower = value.lower()
    covered = sum(len(m[0]) for m in _DICTIONARY.finditer(lower)) / n
    words, own, path = set(_WORD.findall(near.lower())), name.lower(), set(_WORD.findall((source or "").lower()))
    counted = lambda known, where: sum(w in where for w in known)
    return [
        KINDS.index(kind), n, entropy, kinds.count(0) / n, kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
        sum(c in "0123456789abcdefABCDEF" for c in value) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / max(1, n - 1),
        covered, counted(SECRET_WORDS, words), counted(DOUBT_WORDS, words),
        float(_is_credential(own)), float(bool(set(_WORD.findall(own.replace("_", " "))) & set(DOUBT_WORDS))),
        counted(DOUBT_WORDS, path), sum(c in "aeiou" for c in lower) / n, len(_WORD.findall(value)), len(counts) / n,
    ]


def read(text: str | None, source: str | None) -> list[tuple[int, str, str, list[float]]]:
    """``(start, value, kind, features)`` of every candidate of a text."""
    return [(start, value, kind, features(value, kind, name, around(text, start, start + len(value)), source)) for start, value, kind, name in find(text)]


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, length, kind, sha256, x)`` of every candidate in every text."""
    names = ["doc_id", "start", "length", "kind", "sha256", "x"]

    def run(batches):
        for batch in batches:
            at, out = [], []
            for i, (text, source) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for start, value, kind, x in read(text, source):
                    at.append(i)
                    out.append((start, len(value), kind, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest(), x))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"), source.alias("source"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, start long, length long, kind string, sha256 string, x array<double>")


def written_findings(count: int = TRAIN_FINDINGS) -> list[tuple[int, list[float]]]:
    """``(label, features)`` of the candidates at the labelled places of ``findings.labelled``."""
    out = []
    for text, source, start, label in labelled(count):
        out += [(label, x) for at, _, _, x in read(text, source) if at == start]
    return out


class Forest:
    """Bagged trees with a random subset of features at each split and Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.constant = float((y.sum() + 1) / (len(y) + 2)) if min((y == 0).sum(), (y == 1).sum()) < 2 else None
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES if self.constant is None else 0):
            pick = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[pick], y[pick], DEPTH, rng))

    def _grow(self, x, y, depth, rng):
        p = float(y.mean())
        if depth == 0 or len(y) < 2 * LEAST_LEAF or p in (0.0, 1.0):
            return p
        best = None
        for f in rng.permutation(x.shape[1])[: max(2, int(math.sqrt(x.shape[1])) + 1)]:
            for cutpoint in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))):
                left = x[:, f] <= cutpoint
                n = int(left.sum())
                if LEAST_LEAF <= n <= len(y) - LEAST_LEAF:
                    a, b = y[left].mean(), y[~left].mean()
                    impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                    if best is None or impurity < best[0]:
                        best = (impurity, f, cutpoint, left)
        if best is None:
            return p
        _, f, cutpoint, left = best
        return (int(f), float(cutpoint), self._grow(x[left], y[left], depth - 1, rng), self._grow(x[~left], y[~left], depth - 1, rng))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        out = np.zeros(len(x))

        def walk(node, rows):
            if isinstance(node, tuple):
                left = x[rows, node[0]] <= node[1]
                walk(node[2], rows[left])
                walk(node[3], rows[~left])
            else:
                out[rows] += node

        for tree in self.trees:
            walk(tree, np.arange(len(x)))
        return out / len(self.trees)


def _drawn(found: DataFrame, findings: DataFrame) -> list[tuple[int, list[float]]]:
    """``(label, features)`` of given findings, at most about TRAIN_FINDINGS of each class."""
    given = findings.select("doc_id", "start", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    known = found.hint("merge").join(given.hint("merge"), ["doc_id", "start"])
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("label") == label) & (draw < share(TRAIN_FINDINGS, n)))
    rows = known.where(keep).select("doc_id", "start", "label", "x").collect()
    return [(r["label"], r["x"]) for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"], r["label"]))]


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, length, kind, sha256, score, is_secret)`` of every candidate; ``findings`` is (doc_id, start, label)."""
    found = cut(candidates(docs))
    sample = written_findings() if findings is None else _drawn(found, findings)
    forest = Forest(np.array([x for _, x in sample]).reshape(-1, len(NAMES)), np.array([label for label, _ in sample], float))

    def run(batches):
        for batch in batches:
            x = batch.column(5).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(forest.score(x))], ["doc_id", "start", "length", "kind", "sha256", "score"])

    scored = found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, start long, length long, kind string, sha256 string, score double")
    # a known format is a secret whatever stands around it
    return scored.withColumn("is_secret", (F.col("score") >= 0.5) | F.col("kind").isin("aws_key", "github", "slack", "jwt", "pem"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per candidate of a document: doc_id, start, length, kind, sha256 of the value, score (0 to 1, higher: a secret) and is_secret."""
    return scan(table(spark, sf_dir, "documents"))
