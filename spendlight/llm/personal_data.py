"""Personal data by bootstrapped contextual extraction.

Seeds are what exact rules find: e-mail and IP addresses, card and phone numbers. Candidates are
looser forms that those rules miss: other words with an at sign, spelled addresses, colon-separated
addresses, and numbers of 7 to 19 digits in any grouping. Each mention's neighbourhood
induces lexical patterns: the two words before it, the word before and the word after, and the two words after, digits as 0
(signs are words). Mentions' values and their patterns are a bipartite graph, an edge once, so copies of a
document weigh nothing.

Spark then scores that graph in ROUNDS rounds. A pattern's confidence for a kind is the sum S of its
values' scores for that kind over S + 1 + its other values (seeds of other kinds count 1, candidates
UNKNOWN), if SUPPORT values of the kind hold it; a candidate's score for a kind its form allows is the chance that one of its confident patterns is right.
Seeds score 1 for their kind; candidates of PROMOTED and more count as values in the next round, so that what they are found
beside teaches new patterns. After the last round all mentions of promoted candidates are added under their best kind.

Nulls: a null text holds nothing, a null doc_id is kept. Repeated rows are searched and returned
each. Other columns are ignored; an empty table gives no rows. Texts are searched whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.tables import table
from spendlight.storage import scratch, store

ROUNDS, SUPPORT, CONFIDENT, PROMOTED, UNKNOWN = 3, 3, 0.6, 0.8, 0.25
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[\[(]at[\])]")

# looser forms; each begins where no run of its signs has begun before, so that a text is read once
_SIGNED = re.compile(r"(?<![^\s@<>()\[\]{},;\"'])[^\s@<>()\[\]{},;\"']++@[^\s@<>()\[\]{},;\"']*(?<=[\w-])")
_SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]++ ?[\[(]at[\])] ?[\w-]++(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]++)++")
_COLONS = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
_NUMBER = re.compile(r"(?<![\w.+/-])\+?\(?[0-9](?:[ ()./-]{0,2}[0-9])*+(?!\w)")
#: Words of a context that are longer than this are named by a digest.
LONG_WORD = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, EMAIL, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of what the exact rules find, by start and kind; per kind leftmost, without overlaps or second tries."""
    out = list(_emails(text))
    for m in _QUAD.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """``(start, end, kinds)`` of looser forms beside ``base``, in text order and without overlaps."""
    loose = []
    if "@" in text:
        loose += [(m.start(), m.end(), (EMAIL,)) for m in _SIGNED.finditer(text)]
    if "at)" in text or "at]" in text:
        loose += [(m.start(), m.end(), (EMAIL,)) for m in _SPELLED.finditer(text)]
    if ":" in text:
        loose += [(m.start(), m.end(), (IP,)) for m in _COLONS.finditer(text) if any(map(str.isdigit, m[0]))]
    for m in _NUMBER.finditer(text):
        n = sum(map(m[0].count, "0123456789"))
        kinds = ((IP,) if _QUAD.fullmatch(m[0]) else ()) + ((CARD,) if 12 <= n <= 19 else ()) + ((PHONE,) if 7 <= n <= 15 else ())
        if kinds and 7 <= n <= 19:
            loose.append((m.start(), m.end(), kinds))
    out, free, taken = [], 0, iter([*sorted((s, e) for s, _, e in base), (len(text) + 1, len(text) + 1)])
    start, end = next(taken)
    for low, high, kinds in sorted(loose):
        while end <= low:
            start, end = next(taken)
        if low >= free and high <= start:
            out.append((low, high, kinds))
            free = high
    return out


def _word(word: str) -> str:
    word = re.sub("[0-9]", "0", word.lower())
    return word if len(word) <= LONG_WORD else hashlib.sha256(word.encode()).hexdigest()[:24]


_NEXT = re.compile(r"\w++|[^\w\s]")


def _after(text: str, end: int) -> list[str]:
    out = []
    for _ in range(2):
        m = _NEXT.search(text, end)
        if not m:
            break
        out.append(_word(m[0]))
        end = m.end()
    return out


def _before(text: str, start: int) -> list[str]:
    out: list[str] = []
    while start > 0 and len(out) < 2:
        c = text[start - 1]
        low = start - 1
        if c.isalnum() or c == "_":
            while low > 0 and (text[low - 1].isalnum() or text[low - 1] == "_"):
                low -= 1
            out.append(_word(text[low:start]))
        elif not c.isspace():
            out.append(c)
        start = low
    return out[::-1]


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a mention; a missing neighbour is the text's edge."""
    left, right = ["^", "^", *_before(text, start)][-2:], [*_after(text, end), "$", "$"][:2]
    return [f"{left[0]} {left[1]} _", f"{left[1]} _ {right[0]}", f"_ {right[0]} {right[1]}"]


def _value(kinds: tuple[int, ...], text: str) -> int:
    """A mention's value as a number: the hash of its digits, of an address all its signs in lower case."""
    plain = text.lower() if EMAIL in kinds or IP in kinds else "".join(c for c in text if c.isdecimal())
    return int.from_bytes(hashlib.blake2b(plain.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))])
_FOUND = "base array<struct<start: long, kind: int, end: long>>, mentions array<struct<start: long, end: long, seed: int, kinds: array<int>, value: long, patterns: array<string>>>"


def mentions_of(text: str) -> tuple[list[dict], list[dict]]:
    """The exact spans of a text, and all mentions with their patterns (seed -1: a candidate)."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    every = [(s, e, kind, (kind,)) for s, kind, e in base] + [(s, e, -1, kinds) for s, e, kinds in candidates(text, base)]
    spans = [{"start": s, "kind": kind, "end": e} for s, kind, e in base]
    return spans, [{"start": s, "end": e, "seed": seed, "kinds": kinds, "value": _value(kinds, text[s:e]), "patterns": patterns_of(text, s, e)} for s, e, seed, kinds in every]


def find_mentions(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, base, mentions)`` for every row of ``docs``; row is a number of its own."""

    def run(batches):
        for batch in batches:
            found = [mentions_of(x or "") for x in batch.column(2).to_pylist()]
            arrays = [pa.array([f[0] for f in found], pa.list_(_SPAN)), pa.array([f[1] for f in found], pa.list_(_MENTION))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["row", "doc_id", "base", "mentions"])

    slim = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"row long, doc_id {dict(slim.dtypes)['doc_id']}, {_FOUND}")


def score_patterns(edges: DataFrame, totals: DataFrame, scores: DataFrame) -> DataFrame:
    """``(pattern, kind, confidence)`` of confident patterns, from ``edges`` (value, pattern), ``totals`` (pattern, total weight) and ``scores`` (value, kind, score, weight)."""
    sums = (F.sum("score").alias("held"), F.sum("weight").alias("own"), F.count(F.lit(1)).alias("n"))
    held = edges.hint("merge").join(scores.hint("merge"), "value").groupBy("pattern", "kind").agg(*sums)
    rated = held.where(F.col("n") >= SUPPORT).hint("merge").join(totals.hint("merge"), "pattern")
    confidence = F.col("held") / (F.col("held") + F.col("total") - F.col("own") + 1)
    return rated.select("pattern", "kind", F.round(confidence, 9).alias("confidence")).where(F.col("confidence") >= CONFIDENT)


def score_values(edges: DataFrame, patterns: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(value, kind, score)`` of the candidates ``allowed`` (value, kind) that a confident pattern holds."""
    near = edges.hint("merge").join(patterns.hint("merge"), "pattern")
    chance = near.groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("confidence")))), 9).alias("score"))
    return chance.hint("merge").join(allowed.hint("merge"), ["value", "kind"])


def bootstrap(mentions: DataFrame, keep=store) -> tuple[DataFrame, DataFrame]:
    """``(scores, patterns)``: promoted candidates (value, kind, score) and confident patterns (pattern, kind, confidence) after the last round."""
    # a value that is exact somewhere weighs as a seed everywhere
    every = keep(mentions.select("value", F.explode("patterns").alias("pattern")).distinct())
    seeds = keep(mentions.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct())
    exact = keep(seeds.select("value").distinct())
    weighed = every.hint("merge").join(exact.withColumn("weight", F.lit(1.0)).hint("merge"), "value", "left").withColumn("weight", F.coalesce("weight", F.lit(UNKNOWN)))
    # a pattern of fewer values can never have the support
    totals = keep(weighed.groupBy("pattern").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT).drop("n"))
    edges = keep(every.hint("merge").join(totals.select("pattern").hint("merge"), "pattern").select("value", "pattern"))
    allowed = mentions.where("seed < 0").select("value", F.explode("kinds").alias("kind")).distinct()
    allowed = keep(allowed.hint("merge").join(exact.hint("merge"), "value", "left_anti"))
    certain = seeds.withColumn("score", F.lit(1.0)).withColumn("weight", F.lit(1.0))
    promoted, patterns = certain.where("false").drop("weight"), None
    for _ in range(ROUNDS):
        patterns = keep(score_patterns(edges, totals, certain.unionByName(promoted.withColumn("weight", F.lit(UNKNOWN)))))
        promoted = keep(score_values(edges, patterns, allowed).where(F.col("score") >= PROMOTED))
    return promoted, patterns


def extract(docs: DataFrame, keep=store) -> tuple[DataFrame, DataFrame]:
    """``(spans, patterns)``: ``(doc_id, base, added)`` for every row, spans as (start, kind, end), and the confident patterns."""
    found = keep(find_mentions(docs))
    mentions = keep(found.select("row", F.explode("mentions").alias("m")).select("row", "m.*"))
    promoted, patterns = bootstrap(mentions, keep)
    # of equal scores the kind that is named first
    best = keep(promoted.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind")))
    # a value that is also found exactly somewhere is known to be of that kind
    known = mentions.where("seed >= 0").groupBy("value").agg(F.min("seed").alias("kind"))
    hits = mentions.where("seed < 0").select("row", "value", "start", "end").hint("merge").join(keep(best.unionByName(known)).hint("merge"), "value")
    added = keep(hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added")))
    both = found.select("row", "doc_id", "base").hint("merge").join(added.hint("merge"), "row", "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    return both.select("doc_id", "base", F.coalesce("added", none).alias("added")), patterns


def _named(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the exact spans, and all spans as text."""
    with scratch(spark) as keep:
        spans, _ = extract(table(spark, sf_dir, "documents"), keep)
        kinds = F.col("base.kind")
        counts = [(F.size(kinds) - F.size(F.array_remove(kinds, F.lit(k)))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
        return store(spans.select("doc_id", *counts, F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.concat("base", "added")).alias("spans")))
