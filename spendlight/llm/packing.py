"""Packing documents into training sequences by lexical retrieval over a sharded BM25 index.

A document's ids are those of the byte-level BPE vocabulary plus id 0 at the end. Every full window
of a document is a sequence of its own; what is left of it is packed with its neighbours. A left
piece's two leading terms are the ids that weigh most in it by BM25 among those that other pieces
have too. The left pieces are dealt out by the first, ordered by both and cut into shards of neighbours along
that order, so that pieces with the same rare terms meet, however large the corpus is; a term that
more pieces have than a task takes is dealt into as many parts as these need. A task builds the BM25 inverted index of one shard
(document frequencies and the mean length come from all pieces of the corpus), and seeds, longest first,
call up the unused pieces that score best and take those that fit whole, then cut the best remaining one to
fill the window. A seed doesn't see the pieces of other shards. A shard's last, short sequence is cut
into lengths that are powers of two, which need no padding.

Ids are computed with the rank file of the same vocabulary, which gives the same ids at an eighth of the time
(tests compare the two). Nulls: a null text counts as empty, which is the single id 0; a null
doc_id is kept. Repeated rows are packed once each. Other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlight.llm.byte_tokens import ByteTokenizer
from spendlight.llm.tables import blocks, table
from spendlight.storage import cut

WINDOW, END_ID, VOCABULARY = 1024, 0, 50257
#: Pieces of a shard, and of a task, which works through several shards one by one.
SHARD_PIECES, TASK_PIECES = 768, 6144
K1, B = 1.2, 0.75


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, ids)``: full windows (ids null) and the rest of each document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]

    def run(batches):
        encode = ByteTokenizer(tokenizer).encode
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], np.uint16)
                n = len(ids)
                for at in range(0, n, window):
                    part = ids[at : at + window]
                    rows.append(i)
                    out.append((at, len(part), crc(part), n, None if len(part) == window else part.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names)

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def document_frequencies(left: DataFrame) -> np.ndarray:
    """In how many pieces each id occurs, over all of them (one count per id of the vocabulary)."""

    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(ids, np.uint16))] += 1
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(total[token])], ["token", "n"])

    out = np.zeros(VOCABULARY, np.int64)
    for r in left.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[r["token"]] = r["n"]
    return out


def leading_terms(left: DataFrame, shared) -> DataFrame:
    """``left`` with ``first`` and ``second``, a piece's ids of most BM25 weight among those of two pieces at least (-1: none), and the ``parts`` of the first."""
    kind = dict(left.dtypes)["doc_id"]

    def run(batches):
        idf, mean, parts = shared.value
        for batch in batches:
            tops = np.full((batch.num_rows, 2), -1, np.int32)
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                token, tf = np.unique(np.frombuffer(ids, np.uint16), return_counts=True)
                known = parts[token] > 0
                token, tf = token[known], tf[known]
                weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / 2 / mean))
                best = np.argsort(-weight, kind="stable")[:2]
                tops[i, : len(best)] = token[best]
            split = np.where(tops[:, 0] >= 0, parts[tops[:, 0]], parts.max(initial=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops[:, 0]), pa.array(tops[:, 1]), pa.array(split)], [*batch.schema.names, "first", "second", "parts"])

    return left.mapInArrow(run, f"doc_id {kind}, start long, doc_tokens long, ids binary, row long, first int, second int, parts int")


def pack_shard(arrays: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """``(piece, from, length, sequence, offset)`` for the pieces of one shard."""
    n = len(arrays)
    lengths = np.array([len(a) for a in arrays])
    tokens, counts, owners = [], [], []
    for i, a in enumerate(arrays):
        t, c = np.unique(a, return_counts=True)
        tokens.append(t)
        counts.append(c)
        owners.append(np.full(len(t), i, np.int32))
    first = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    token, tf, owner = np.concatenate(tokens), np.concatenate(counts).astype(np.float64), np.concatenate(owners)
    weight = (idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[owner] / mean_length))).astype(np.float32)
    order = np.argsort(token, kind="stable")
    posting_doc, posting_weight, sorted_token = owner[order], weight[order], token[order]
    head = np.searchsorted(sorted_token, token, "left")
    tail = np.searchsorted(sorted_token, token, "right")
    used, start, left = np.zeros(n, bool), np.zeros(n, np.int64), lengths.copy()
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for seed in np.argsort(-lengths, kind="stable"):
        if used[seed]:
            continue
        used[seed] = True
        filled, taken = int(left[seed]), [(int(seed), int(start[seed]), int(left[seed]))]
        free = np.flatnonzero(~used)
        if len(free) and filled < window:
            spans = [(head[p], tail[p]) for p in range(first[seed], first[seed + 1]) if tail[p] - head[p] > 1]
            score = np.zeros(n)
            if spans:
                docs = np.concatenate([posting_doc[a:b] for a, b in spans])
                score = np.bincount(docs, np.concatenate([posting_weight[a:b] for a, b in spans]), minlength=n)
            ranked = free[np.argsort(-score[free], kind="stable")]
            open_ = np.ones(len(ranked), bool)
            while filled < window:
                fits = np.flatnonzero(open_ & (left[ranked] <= window - filled))
                if not len(fits):
                    break
                best = ranked[fits[0]]
                open_[fits[0]] = False
                used[best] = True
                taken.append((int(best), int(start[best]), int(left[best])))
                filled += int(left[best])
            rest = np.flatnonzero(open_)
            if filled < window and len(rest):
                best, room = ranked[rest[0]], window - filled
                taken.append((int(best), int(start[best]), room))
                start[best] += room
                left[best] -= room
                filled = window
        sizes = [window] if filled == window else [1 << b for b in range(filled.bit_length() - 1, -1, -1) if filled >> b & 1]
        offset, size = 0, 0
        for piece, at, length in taken:
            while length:
                part = min(length, sizes[size] - offset)
                out.append((piece, at, part, sequence, offset))
                at, length, offset = at + part, length - part, offset + part
                if offset == sizes[size]:
                    sequence, offset, size = sequence + 1, 0, size + 1
    return out


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut_up = cut(pieces(docs, window, tokenizer))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = cut_up.where(F.col("ids").isNull()).select(*columns, (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut_up.where(F.col("ids").isNotNull())
    size = left.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    df = document_frequencies(left)
    idf = np.log1p((size["n"] - df + 0.5) / (df + 0.5))
    # no more pieces can begin with a term than hold it; terms of one piece lead nowhere
    parts = np.where(df >= 2, np.ceil(df / TASK_PIECES), 0).astype(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((idf, float(size["mean"] or 1), parts))  # two values for each id of the vocabulary
    marked = leading_terms(left.select("doc_id", "start", "doc_tokens", "ids", F.monotonically_increasing_id().alias("row")), shared)
    dealt = marked.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).repartition(blocks(size["n"], TASK_PIECES), "first", "part")
    dealt = dealt.sortWithinPartitions("first", "part", "second", "row")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        idf, mean, _ = shared.value
        base, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= 2 * SHARD_PIECES:
                out, base = packed_shard(held.slice(0, SHARD_PIECES), idf, mean, window, base)
                held = held.slice(SHARD_PIECES)
                yield from out.to_batches()
        if held is not None and held.num_rows:
            yield from packed_shard(held, idf, mean, window, base)[0].to_batches()

    packed = dealt.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(packed)


def packed_shard(group: pa.Table, idf: np.ndarray, mean: float, window: int, base: int) -> tuple[pa.Table, int]:
    """The rows of one shard's pieces, with sequence ids from ``base`` on, and the next id."""
    arrays = [np.frombuffer(x, np.uint16) for x in group.column("ids").to_pylist()]
    start, total = group.column("start").to_numpy(), group.column("doc_tokens").to_numpy()
    piece, at, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pack_shard(arrays, idf, mean, window), strict=True))
    crcs = np.array([crc(arrays[p][a : a + k]) for p, a, k in zip(piece, at, length, strict=True)], np.int64)
    doc_ids = group.column("doc_id").combine_chunks().take(pa.array(piece))
    out = pa.table({"doc_id": doc_ids, "start": start[piece] + at, "length": length, "ids_crc32": crcs, "doc_tokens": total[piece], "sequence_id": (base + sequence) * 2, "offset": offset})
    return out, base + int(sequence.max()) + 1


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"))
