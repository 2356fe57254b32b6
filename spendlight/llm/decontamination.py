"""Benchmark decontamination by latent semantic retrieval with subsequence and answer checks.

Words are the lower-cased text's parts between white space, less all signs that are neither letters nor
digits, hashed into BUCKETS. One pass over all documents counts the buckets' document frequencies and
sketches all TF-IDF passages of PASSAGE words, a document's last and shorter one included: the
randomised range finder adds each passage, with a random sign, to one of SKETCH rows. The summed
sketch, with that of the benchmark's own items, is decomposed, and its leading right singular vectors
span the latent space, in which every eighth word begins a window of about an item's length.

A window is a candidate for an item if the cosine of the two in the latent space reaches MIN_COSINE.
It counts if MIN_ANSWER of the item's answer (its rarest third of words, or the ``answer`` column if
there is one) occur in the window's neighbourhood, and the longest common subsequence of item and
neighbourhood covers MIN_LCS of the item. By the answer check only windows near a word that is among
the rarest of an answer can count, so that only there cosines are taken: an item's answer can miss
so many words before one of the others must occur. A second pass finds these places, whatever the
number of items, by a table of fixed size.

Items with fewer than MIN_ITEM_WORDS words count where all their words occur in a row, and items in
scripts without blanks between words where all their letters and digits do, white space and other
signs set aside; near copies of these are not looked for.

Items are worked through in blocks of ITEM_BLOCK, so what a task holds is bounded. Nulls: null
texts hold no words and never match; items without a letter or digit or with a null item_id
take no part. One row per pair of document row and distinct item row: repeated documents each match,
repeated items once. Other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spendlight.llm.tables import blocks, table, text_key, without_texts
from spendlight.storage import cut

BUCKETS, SKETCH, RANK = 8192, 127, 96
PASSAGE = 32
STEP, SIZES = 8, (16, 32, 64)
MIN_COSINE, MIN_LCS, MIN_ANSWER, MIN_ITEM_WORDS = 0.2, 0.55, 0.5, 8
ITEM_BLOCK = 16384
#: Entries of the table of word hashes, and of the rows that partial sketches travel in.
PLACES, CHUNK = 1 << 22, 4096
#: Documents that are worked through at a time.
AT_ONCE = 256
_OTHER = re.compile(r"[\W_]+")
#: Scripts that are written without blanks between words: Thai to Myanmar, Khmer, kana, and Chinese characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Words:
    """Hashes of a text's words; remembers the tokens met last."""

    def __init__(self, most: int = 400_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        """One 32-bit hash per word; tokens without letters or digits are skipped."""
        if not text:
            return np.zeros(0, np.int64)
        seen = self.seen
        tokens = text.lower().split()
        try:
            ids = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(seen) > self.most:
                seen.clear()
            for t in set(tokens).difference(seen):
                core = t if t.isalnum() else _OTHER.sub("", t)
                seen[t] = zlib.crc32(core.encode("utf-8", "replace")) if core else -1
            ids = np.fromiter(map(seen.__getitem__, tokens), np.int64, len(tokens))
        return ids[ids >= 0] if len(ids) and ids.min() < 0 else ids


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers for 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch_rows(key: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of a document's words the sketch row and the sign of its passage, from the document's key and the passage's number."""
    passages = np.arange(-(-words // PASSAGE), dtype=np.uint64) + np.uint64(zlib.crc32(key) << 24)
    x = _mixed(passages + np.uint64(0x9E3779B97F4A7C15))
    at = np.arange(words) // PASSAGE
    return (x % np.uint64(SKETCH)).astype(np.int64)[at], np.where(x >> np.uint64(63), 1.0, -1.0)[at]


def corpus_sketch(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many documents hold each bucket, and the sketch (SKETCH x BUCKETS) of all documents' passages as word counts.

    A task sums what it reads; the partial sums are added in ranges by tasks that hold one sum each.
    """

    def run(batches):
        total, words, any_ = np.zeros((SKETCH + 1, BUCKETS), np.int64), Words(), False
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                cells, signs, part = [], [], batch.slice(at, AT_ONCE)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = words(text) % BUCKETS
                    if len(ids):
                        mark = np.zeros(BUCKETS, bool)
                        mark[ids] = True
                        total[SKETCH] += mark
                        rows, sign = sketch_rows((key or "").encode("utf-8", "replace"), len(ids))
                        cells.append(rows * BUCKETS + ids)
                        signs.append(sign)
                if cells:
                    sums = np.bincount(np.concatenate(cells), np.concatenate(signs), minlength=SKETCH * BUCKETS)
                    total[:SKETCH] += sums.astype(np.int64).reshape(SKETCH, BUCKETS)
                    any_ = True
        if any_:
            yield from _parts(dict(enumerate(total.reshape(-1, CHUNK))))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield from _parts(sums)

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "chunk int, part binary")
    out = np.zeros(((SKETCH + 1) * BUCKETS // CHUNK, CHUNK), np.int64)
    for r in parts.repartition(32, "chunk").mapInArrow(add, "chunk int, part binary").collect():  # one sketch in all
        out[r["chunk"]] = np.frombuffer(r["part"], np.int64)
    out = out.reshape(SKETCH + 1, BUCKETS)
    return out[SKETCH], out[:SKETCH]


def _parts(sums: dict[int, np.ndarray]):
    for chunk, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "part"])


def latent_basis(items: list[np.ndarray], sketch: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (BUCKETS x rank) of the corpus' sketch over that of the items."""
    own = np.zeros((SKETCH, BUCKETS))
    for n, words in enumerate(items):
        x = _mixed(np.array([n], np.uint64))[0]
        np.add.at(own[int(x) % SKETCH], words % BUCKETS, (1.0 if int(x) >> 63 else -1.0) / np.sqrt(len(words)))
    both = []
    for rows in (own, sketch):
        rows = rows * idf
        size = np.linalg.norm(rows)
        both.append(rows / size if size else rows)
    # the benchmark weighs twice as much as the corpus in total
    _, _, right = np.linalg.svd(np.vstack([2.0 * both[0], both[1]]), full_matrices=False)
    return np.ascontiguousarray(right[:rank].T)


def lcs(item: list[int], words) -> int:
    """Length of the longest common subsequence, one bit per word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


class Matcher:
    """The items of one block: their answers, their places in the latent space, and the checks of a window."""

    def __init__(self, items, idf, basis):
        self.keys = [k for k, _, _ in items]
        self.words = [w.tolist() for _, w, _ in items]
        self.sizes = [min(SIZES, key=lambda size, n=len(w): abs(np.log(size / n))) for w in self.words]
        #: A bucket's part of a window's place in the latent space.
        self.weights = (basis * idf[:, None]).astype(np.float32)
        self.places = np.array([self.place(w) for _, w, _ in items]) if items else np.zeros((0, 1))
        self.answers, self.needed, pairs = [], [], []
        for i, (w, (_, _, answer)) in enumerate(zip(self.words, items, strict=True)):
            rare = sorted(set(answer or w), key=lambda x: (-idf[x % BUCKETS], x))
            rare = rare if answer else rare[: max(1, len(rare) // 3)]
            self.answers.append(set(rare))
            # a window that holds MIN_ANSWER of the answer holds one of these
            needed = max(1, int(np.ceil(MIN_ANSWER * len(rare) - 1e-9)))
            self.needed.append(needed)
            pairs += [(x, i) for x in rare[: len(rare) - needed + 1]]
        pairs.sort()
        self.firsts = np.array([x for x, _ in pairs], np.int64)
        self.owners = np.array([i for _, i in pairs], np.int64)

    def place(self, words: np.ndarray) -> np.ndarray:
        """The unit vector of a run of words in the latent space (zero if nothing of it lies there)."""
        x = self.weights[np.asarray(words) % BUCKETS].sum(axis=0)
        return x / max(float(np.linalg.norm(x)), 1e-9)

    def match(self, words: np.ndarray, at: np.ndarray) -> list[tuple]:
        """``(key, cosine, lcs share, answer share, first word)``: the best passing window of each item; ``at`` are places to look near."""
        hits = words[at]
        low, high = np.searchsorted(self.firsts, hits, "left"), np.searchsorted(self.firsts, hits, "right")
        known = high > low
        at, low, high = at[known], low[known], high[known]
        owners: dict[int, list[int]] = {}
        for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for i in self.owners[a:b].tolist():
                owners.setdefault(i, []).append(p)
        if not owners:
            return []
        # what the whole document doesn't hold no window of it does
        present = set(words.tolist())
        near: dict[int, set[int]] = {}
        for i, places in owners.items():
            if len(self.answers[i] & present) >= self.needed[i]:
                size, pad = self.sizes[i], self.pad(i)
                for p in places:
                    # windows whose neighbourhood holds the word
                    first = max(0, (p - size - pad) // STEP + 1)
                    near.setdefault(i, set()).update(range(first, min(p + pad, len(words) - 1) // STEP + 1))
        out = []
        for i, steps in sorted(near.items()):
            if found := self.best(words, i, sorted(steps)):
                out.append((self.keys[i], *found))
        return out

    def pad(self, i: int) -> int:
        return max(STEP, len(self.words[i]) // 2)

    def best(self, words: np.ndarray, i: int, steps: list[int]) -> tuple | None:
        item, answer, size, pad, best = self.words[i], self.answers[i], self.sizes[i], self.pad(i), None
        for step in steps:
            first = step * STEP
            near = words[max(0, first - pad) : first + size + pad].tolist()
            part = len(answer.intersection(near)) / len(answer)
            if part < MIN_ANSWER:
                continue
            cosine = min(1.0, float(self.place(words[first : first + size]) @ self.places[i]))
            if cosine < MIN_COSINE:
                continue
            common = lcs(item, near) / len(item)
            if common >= MIN_LCS and (best is None or (common, cosine) > (best[1], best[0])):
                best = (cosine, common, part, first)
        return best


class Exact:
    """The short items and those in unspaced scripts, which are met as they are."""

    def __init__(self, short, unspaced):
        self.by_first: dict[int, list] = {}
        for key, w in short:
            self.by_first.setdefault(int(w[0]), []).append((key, w))
        self.by_core: dict[str, list] = {}
        for key, core in unspaced:
            self.by_core.setdefault(core, []).append(key)

    def automaton(self):
        """Finds all unspaced items in one pass over a text."""
        if not self.by_core:
            return None
        found = ahocorasick.Automaton()
        for core, keys in self.by_core.items():
            found.add_word(core, (len(core), keys))
        found.make_automaton()
        return found

    def short(self, words: np.ndarray, at: np.ndarray) -> list[tuple]:
        """``(key, 1, 1, 1, first word)`` of each short item that occurs, at its first place; ``at`` are places to look at."""
        best: dict = {}
        for p in at.tolist():
            for n, (key, w) in enumerate(self.by_first.get(int(words[p]), ())):
                if (where := (int(words[p]), n)) not in best and np.array_equal(words[p : p + len(w)], w):
                    best[where] = (key, 1.0, 1.0, 1.0, p)
        return list(best.values())

    @staticmethod
    def unspaced(automaton, text: str | None) -> list[tuple]:
        if automaton is None or not text or text.isascii():
            return []
        cores = [c for c in (_OTHER.sub("", t) for t in text.lower().split()) if c]
        ends, best = np.cumsum([len(c) for c in cores]), {}
        for end, (length, keys) in automaton.iter("".join(cores)):
            for n, key in enumerate(keys):
                if (length, keys[0], n) not in best:
                    best[length, keys[0], n] = (key, 1.0, 1.0, 1.0, int(np.searchsorted(ends, end - length + 1, "right")))
        return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, first_word)`` for each document that holds an item."""
    spark, words = docs.sparkSession, Words()
    frequency, sketch = corpus_sketch(docs)
    idf = np.log((docs.count() + 1) / (frequency + 0.5)).clip(0.05)
    usable = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    usable = usable.select("item_id", F.col("text").cast("string").alias("text"), answer.alias("answer")).distinct()
    n_blocks = blocks(usable.count(), ITEM_BLOCK)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind, item_type = dict(slim.dtypes)["doc_id"], usable.schema["item_id"].dataType
    result = None
    for block in range(n_blocks):
        rows = usable.where(F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(n_blocks)) == block).orderBy("item_id", "text", "answer").collect()
        bare = [x for x in ((r["item_id"], _OTHER.sub("", r["text"].lower())) for r in rows if _UNSPACED.search(r["text"])) if x[1]]
        items = [(r["item_id"], words(r["text"]), words(r["answer"]).tolist() if r["answer"] else None) for r in rows if not _UNSPACED.search(r["text"])]
        exact = Exact([(k, w) for k, w, _ in items if 0 < len(w) < MIN_ITEM_WORDS], bare)
        items = [x for x in items if len(x[1]) >= MIN_ITEM_WORDS]
        matcher = Matcher(items, idf, latent_basis([w for _, w, _ in items], sketch, idf))
        places = np.zeros(PLACES, bool)
        places[np.concatenate([matcher.firsts, np.array(list(exact.by_first), np.int64)]) % PLACES] = True
        shared = spark.sparkContext.broadcast((matcher, exact, places))  # at most ITEM_BLOCK items and a table of fixed size

        def run(batches, shared=shared):
            (matcher, exact, places), own = shared.value, Words()
            automaton = exact.automaton()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = own(text)
                    near = np.flatnonzero(places[ids % PLACES])
                    hits = matcher.match(ids, near) + exact.short(ids, near) if len(near) else []
                    for hit in hits + exact.unspaced(automaton, text):
                        at.append(i)
                        found.append(hit)
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], to_arrow_type(item_type)), *(pa.array(c, pa.float64()) for c in columns[1:4]), pa.array(columns[4], pa.int64())],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"],
                )

        part = slim.mapInArrow(run, f"doc_id {kind}, item_id {item_type.simpleString()}, cosine double, lcs_share double, answer_share double, first_word long")
        result = part if result is None else result.unionByName(part)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, each row by its own text."""
    named = docs.select(text_key().alias("doc_id"), "text")
    return without_texts(docs, cut(contaminated(named, benchmark).select("doc_id").distinct()), "doc_id")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and benchmark item that it holds: doc_id, item_id, cosine, lcs_share, answer_share, first_word."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
