"""Alignment of two tokenizers' tokens by dividing at shared cuts.

A text is tokenized twice; a place where tokens of both end is a shared cut. An interval of tokens is
divided at a shared cut near its middle: the end of the middle A token is looked up among the B tokens' ends by bisection, then the
ends around it, in windows that double, and the nearest that B shares divides the interval. Both halves go on; an interval without a shared
cut inside is a leaf, a group of tokens that belong together. All intervals of a level, of all texts of a batch, are looked up
at once, so there is no recursion and no step per token.

Where tokens of A and B end together they are linked. The longer one's bytes then end with the shorter
one's, so the id pairs that can ever be linked follow from the two vocabularies alone (some hundred thousand, whatever the
corpus); they are numbered, counted over the corpus by number, and their counts are small enough to be sent to every task.

Nulls: null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have no
tokens (zeros, no groups). Special tokens inside texts are plain text. A null doc_id is kept,
repeated rows are aligned and counted once each, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.byte_tokens import ByteTokenizer
from spendlight.llm.tables import table
from spendlight.storage import scratch, store

#: Characters of texts that are tokenized together, and of the parts into which longer texts are cut.
TOGETHER = 1 << 18
#: A blank between two word characters: both tokenizers begin a token there, whatever stands around it.
_SAFE = re.compile(r"(?<=\w) (?=\w)")


@dataclass
class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the id pairs that can be linked."""

    a_path: str | None = None
    b_path: str | None = None

    def __post_init__(self):
        import public_tokenizers
        import sentencepiece

        self.a = ByteTokenizer(vocabulary_path=self.a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_path or public_tokenizers.path("piece_bpe_32k.model"))
        byte_of = _byte_letters()
        vocabulary = self.a.vocabulary
        names = (vocabulary.id_to_token(i) or "" for i in range(vocabulary.get_vocab_size()))
        self.a_bytes = [bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode() for name in names]
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.keys = self._pairs()

    def _pairs(self) -> np.ndarray:
        """The numbers ``a * |B| + b`` of all pairs of which one's bytes end with the other's, ascending."""
        size, found = len(self.b_bytes), set()
        by_bytes: dict[bytes, list[int]] = {}
        for b, name in enumerate(self.b_bytes):
            by_bytes.setdefault(name, []).append(b)
        for a, name in enumerate(self.a_bytes):
            found.update(a * size + b for at in range(len(name)) for b in by_bytes.get(name[at:], ()))
        by_bytes.clear()
        for a, name in enumerate(self.a_bytes):
            by_bytes.setdefault(name, []).append(a)
        for b, name in enumerate(self.b_bytes):
            found.update(a * size + b for at in range(len(name)) for a in by_bytes.get(name[at:], ()))
        return np.array(sorted(found), np.int64)

    def encode(self, texts: list[str], part: int = TOGETHER) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(A ids, B ids)`` of each text with a blank before it; none of either where bytes are not given back."""
        parts = [cut for text in texts for cut in _cut(" " + text, part)]
        many = [len(_cut(" " + text, part)) for text in texts] if len(parts) > len(texts) else [1] * len(texts)
        one = [self.a.encode(x) for x in parts]
        # each part begins with a blank, which the other tokenizer adds by itself
        two = self.b.encode([x[1:] for x in parts], num_threads=1)
        out, at = [], 0
        for text, n in zip(texts, many, strict=True):
            a, b = ([i for ids in encoded[at : at + n] for i in ids] if n > 1 else encoded[at] for encoded in (one, two))
            at += n
            data = b" " + text.encode()
            whole = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
            out.append((np.array(a if whole and text else [], np.int64), np.array(b if whole and text else [], np.int64)))
        return out


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _cut(text: str, size: int) -> list[str]:
    """``text`` in parts of about ``size`` characters or more, each of which begins at a blank between word characters."""
    out, at = [], 0
    while len(text) - at > size and (found := _SAFE.search(text, at + size)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end a group, for intervals ``[a_lo, a_hi)`` and ``[b_lo, b_hi)`` of tokens that cover the same bytes.

    Both lists of ends ascend strictly over all intervals.
    """
    a_cut, b_cut = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    a_cut[a_hi[a_hi > a_lo] - 1] = True
    b_cut[b_hi[b_hi > b_lo] - 1] = True
    while True:
        more = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[more], a_hi[more], b_lo[more], b_hi[more]
        if not len(a_lo):
            return a_cut, b_cut
        middle = (a_lo + a_hi - 2) // 2
        place = np.searchsorted(ends_b, ends_a[middle])
        cut_a, cut_b = np.where(ends_b[place] == ends_a[middle], middle, -1), place
        near, open_ = 1, np.flatnonzero(cut_a < 0)
        while len(open_):
            # the ends at distances near to 2 * near - 1 from the middle, nearest first
            distance = np.repeat(np.arange(near, 2 * near), 2) * np.tile([-1, 1], near)
            which = np.repeat(open_, len(distance))
            tried = middle[which] + np.tile(distance, len(open_))
            inside = (tried >= a_lo[which]) & (tried <= a_hi[which] - 2)
            which, tried = which[inside], tried[inside]
            place = np.searchsorted(ends_b, ends_a[tried])
            same = ends_b[place] == ends_a[tried]
            first, at = np.unique(which[same], return_index=True)
            cut_a[first], cut_b[first] = tried[same][at], place[same][at]
            near *= 2
            left = (cut_a[open_] < 0) & ((middle[open_] - near >= a_lo[open_]) | (middle[open_] + near <= a_hi[open_] - 2))
            open_ = open_[left]
        split = cut_a >= 0
        cut_a, cut_b = cut_a[split], cut_b[split]
        a_cut[cut_a], b_cut[cut_b] = True, True
        both = lambda low, cut, high: (np.column_stack([low[split], cut]).ravel(), np.column_stack([cut, high[split]]).ravel())
        (a_lo, a_hi), (b_lo, b_hi) = both(a_lo, cut_a + 1, a_hi), both(b_lo, cut_b + 1, b_hi)


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``, from a table of every id with every sign that can follow it."""

    def __init__(self, tokenizers: Tokenizers):
        self.a_size, self.b_size = len(tokenizers.a_bytes), len(tokenizers.b_bytes)
        self.words = [f"{i}{sign}" for size, signs in ((self.a_size, ",|"), (self.b_size, ",;")) for sign in signs for i in range(size)]

    def codes(self, a, b, a_cut, b_cut) -> np.ndarray:
        """Numbers of the words of all groups in order: each group's A tokens, then its B tokens."""
        a_group, b_group = (np.cumsum(cut) - cut for cut in (a_cut, b_cut))
        b_start = np.concatenate([[0], np.flatnonzero(b_cut) + 1])
        a_end = np.flatnonzero(a_cut) + 1
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + b_start[a_group]] = a + self.a_size * a_cut
        out[np.arange(len(b)) + a_end[b_group]] = b + 2 * self.a_size + self.b_size * b_cut
        return out

    def text(self, codes: np.ndarray) -> str:
        return "".join(map(self.words.__getitem__, codes.tolist()))[:-1]


@lru_cache(1)
def loaded(a_path: str | None, b_path: str | None) -> tuple[Tokenizers, Writer]:
    """Both tokenizers and their writer, once a worker."""
    known = Tokenizers(a_path, b_path)
    return known, Writer(known)


def align_batch(known: Tokenizers, writer: Writer, texts: list[str]) -> list[tuple[int, int, int, str, bytes]]:
    """``(n_a, n_b, n_groups, groups, links)`` of each text; links are numbers of id pairs, four bytes each."""
    encoded = known.encode(texts)
    a, b = (np.concatenate([np.empty(0, np.int64), *(x[side] for x in encoded)]) for side in (0, 1))
    a_at, b_at = (np.concatenate([[0], np.cumsum([len(x[side]) for x in encoded])]).astype(np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(known.a_lengths[a]), np.cumsum(known.b_lengths[b])
    a_cut, b_cut = shared_cuts(ends_a, ends_b, a_at[:-1], a_at[1:], b_at[:-1], b_at[1:])
    links = np.searchsorted(known.keys, a[a_cut] * len(known.b_bytes) + b[b_cut]).astype("<u4")
    group_at = np.concatenate([[0], np.cumsum(a_cut)])[a_at]
    codes = writer.codes(a, b, a_cut, b_cut)
    out = []
    for i in range(len(texts)):
        low, high = group_at[i], group_at[i + 1]
        groups = writer.text(codes[a_at[i] + b_at[i] : a_at[i + 1] + b_at[i + 1]])
        out.append((int(a_at[i + 1] - a_at[i]), int(b_at[i + 1] - b_at[i]), int(high - low), groups, links[low:high].tobytes()))
    return out


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, links)`` for every row of ``docs``; see ``align_batch``."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "links"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        known, writer = loaded(a_path, b_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            low = 0
            while low < len(texts):
                high, size = low + 1, len(texts[low])
                while high < len(texts) and size + len(texts[high]) <= TOGETHER:
                    size += len(texts[high])
                    high += 1
                columns = zip(*align_batch(known, writer, texts[low:high]), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)
                low = high

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, groups string, links binary")


def link_counts(aligned: DataFrame, pairs: int) -> np.ndarray:
    """How many links of ``aligned`` hold each of the ``pairs`` numbered id pairs; at most one row a pair reaches the driver."""

    def run(batches):
        total = np.zeros(pairs, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=pairs)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    out = np.zeros(pairs, np.int64)
    for r in aligned.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["pair"]] = r["n"]
    return out


def link_scores(aligned: DataFrame, counts: np.ndarray, keys: np.ndarray, b_size: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` and ``count_sum`` (see the query) in place of its links."""
    highest = np.zeros(b_size, np.int64)
    np.maximum.at(highest, keys % b_size, counts)
    best = (counts > 0) & (counts == highest[keys % b_size])
    # two small arrays of fixed size, one entry for each id pair that the vocabularies allow
    shared = aligned.sparkSession.sparkContext.broadcast((counts, best))
    others = [c for c in aligned.columns if c != "links"]

    def run(batches):
        count, is_best = shared.value
        for batch in batches:
            rows = [np.frombuffer(x, "<u4") for x in batch.column(len(others)).to_pylist()]
            sums = [[len(x) for x in rows], [int(is_best[x].sum()) for x in rows], [int(count[x].sum()) for x in rows]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *(pa.array(x, pa.int64()) for x in sums)], [*others, "n_links", "n_best", "count_sum"])

    kinds = dict(aligned.dtypes)
    return aligned.select(*others, "links").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", n_links long, n_best long, count_sum long")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose id pair is among the most frequent of their B id in the whole corpus, count_sum adds up the
    corpus-wide counts of the links' id pairs; groups_sha256 is '' without tokens.
    """
    known, _ = loaded(None, None)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    with scratch(spark) as keep:
        aligned = keep(align(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
        counts = link_counts(aligned, len(known.keys))
        return store(link_scores(aligned, counts, known.keys, len(known.b_bytes)))
