"""Toxicity classifier: a convolutional network over hashed word embeddings, trained on all labelled rows.

A word's embedding is the mean of the hashed rows of the lower-cased word and of its first four,
five and six letters (so unseen endings share a stem's rows). Filters one, two and three words wide
run over the whole text; each filter's maximum feeds a logistic output. Scoring reads every whole text.

Every labelled row outside the held-out fold teaches, with its whole text, whatever their number. Four
fifths, by a hash, teach the weights; the other fifth the thresholds; the texts that hold a hashed row are
counted over all of them. The labelled texts are dealt into parts, and each part into ROUNDS turns: in a round
each part goes on from the common weights through its texts of that turn, and the parts' changes are
averaged, those of a hashed row by how much each part learned about it. Their sums are taken in
whole numbers, so that they don't depend on the order of addition. Tables of up to VISITS labelled texts are one part,
gone through several times. What passes through the driver is the network, whose size is fixed by BUCKETS and DIM.
The decision threshold is calibrated for each language, where the language is guessed from the text's own
function words, and the score is shifted so that the threshold lies at 0.5.

Nulls: a null text counts as empty; a text without words gets the score of no filter firing. Labels
other than 0 and 1 teach nothing; lang, source, doc_id and held-out labels never reach a score.
Without both classes among the labels every score is the share of label 1 (0.5 without labels).
Equal texts get equal scores. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlight.llm.tables import held_out, table
from spendlight.storage import scratch

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 16, (1, 2, 3)
#: Hashed rows met in fewer labelled texts stay zero: they could only be learned by heart.
LEAST_TEXTS = 4
BATCH, RATE = 32, 0.08
#: Labelled texts and their characters up to which one part goes through all of them, as often as makes so many visits.
VISITS, VISIT_CHARS, MOST_EPOCHS = 16_384, 1 << 27, 40
#: Rounds of more parts, and texts that a part takes in a round.
ROUNDS, TURN_DOCS = 8, 2048
#: Of so many labelled texts one is for the thresholds; labelled texts of each class that a threshold needs.
FOLDS, LEAST = 5, 20
#: Parts of the table of hashed rows that are summed apart; units of the sums; words known at a time.
BLOCKS, UNIT, MOST_WORDS = 16, 2.0**40, 200_000
_WORD = re.compile(r"\w+")

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the of and to in is it that this with for was on are by as",
    "de": "der die und das nicht ein eine mit von zu sich den ist auf dem im",
    "fr": "le la les de et des en un une que pour dans par sur est du",
    "es": "el la los de que en y un una por con para del las se no",
}
LANGUAGES = list(FUNCTION_WORDS)
#: The languages of a function word as bits, and the languages in each such number.
_LANGUAGES_OF = {w: sum(1 << k for k, name in enumerate(LANGUAGES) if w in FUNCTION_WORDS[name].split()) for words in FUNCTION_WORDS.values() for w in words.split()}
_SETS = np.arange(1 << len(LANGUAGES))[:, None] >> np.arange(len(LANGUAGES)) & 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rows_of(word: str) -> tuple[int, int, int, int]:
    """The hashed rows of a word and of its first four, five and six letters, marked by a sign before them."""
    if word.isascii():
        own = word.encode()
        four = zlib.crc32(own[:4], _MARK)
        five = zlib.crc32(own[4:5], four)
        return zlib.crc32(own) % BUCKETS, four % BUCKETS, five % BUCKETS, zlib.crc32(own[5:6], five) % BUCKETS
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in (word, "^" + word[:4], "^" + word[:5], "^" + word[:6]))


_MARK = zlib.crc32(b"^")


class Lexicon(dict):
    """Numbers from 1 of the words met so far, with their hashed rows and the languages whose function words they are; number 0 is padding."""

    def __init__(self):
        self._rows, self._languages = array("i", (0,) * 4), bytearray(1)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        self._rows.extend(rows_of(word))
        self._languages.append(_LANGUAGES_OF.get(word, 0))
        return number

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def rows(self, numbers) -> np.ndarray:
        """A copy, as the rows may move when words come."""
        return np.frombuffer(self._rows, np.int32).reshape(-1, 4)[numbers].copy()

    def guess(self, numbers: np.ndarray) -> str:
        counts = np.bincount(np.frombuffer(self._languages, np.uint8)[numbers], minlength=len(_SETS)) @ _SETS
        return LANGUAGES[counts.argmax()] if counts.any() else "other"


#: Words of a text up to which its windows are held at once.
PIECE = 8192


class Network:
    """Weights, the forward pass and steps of descent."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, DIM)) * 0.06).astype(np.float32)
        #: All that is small, side by side: filters, biases, output weights and offset.
        filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32).reshape(-1) for w in WIDTHS]
        units = len(WIDTHS) * FILTERS
        out = (rng.standard_normal(units) * 0.3).astype(np.float32)
        self.small = np.concatenate([*filters, np.zeros(units, np.float32), out, np.float32([-1.0])])
        self.known = np.ones(BUCKETS, bool)
        self.g_table, self.g_small = np.full(BUCKETS, 1e-3, np.float32), np.full(len(self.small), 1e-3, np.float32)
        self.shift: dict[str, float] = {}
        self.constant: float | None = None

    def views(self, small: np.ndarray):
        """The filters by width and place, biases and output weights as views of ``small``, whose last entry is the offset."""
        size, at, filters = DIM * FILTERS, 0, []
        for width in WIDTHS:
            filters.append([small[at + j * size : at + (j + 1) * size].reshape(DIM, FILTERS) for j in range(width)])
            at += width * size
        units = len(WIDTHS) * FILTERS
        return filters, small[at : at + units], small[at + units : at + 2 * units]

    def projected(self, rows: np.ndarray) -> list[list[np.ndarray]]:
        """What each filter place makes of words with these hashed rows; added up one by one, as products of matrices round by their shapes."""
        emb = self.table[rows].mean(axis=1)
        filters = np.concatenate([f for places in self.views(self.small)[0] for f in places], axis=1)
        total = np.zeros((len(emb), filters.shape[1]), np.float32)
        for d in range(DIM):
            total += emb[:, d, None] * filters[d]
        parts = iter(np.split(total, filters.shape[1] // FILTERS, axis=1))
        return [[next(parts) for _ in range(width)] for width in WIDTHS]

    def maxima(self, numbers: np.ndarray, projected: list[list[np.ndarray]], where: bool = False):
        """Each filter's maximum over a text's windows, PIECE at a time; with ``where`` also the words of those windows.

        Windows that reach beyond the text see zeros there.
        """
        at = np.concatenate([numbers, np.zeros(max(WIDTHS), np.int32)])
        best = np.full((len(WIDTHS), FILTERS), -np.inf, np.float32)
        words = np.zeros((len(WIDTHS), FILTERS, max(WIDTHS)), np.int32)
        for k, width in enumerate(WIDTHS):
            count = len(at) - width + 1
            for low in range(0, count, PIECE):
                high = min(low + PIECE, count)
                conv = projected[k][0].take(at[low:high], axis=0)
                for j in range(1, width):
                    conv += projected[k][j].take(at[low + j : high + j], axis=0)
                if not where:
                    np.maximum(best[k], conv.max(axis=0), out=best[k])
                    continue
                place = conv.argmax(axis=0)
                top = conv[place, np.arange(FILTERS)]
                better = top > best[k]
                best[k][better] = top[better]
                for j in range(width):
                    words[k, better, j] = at[low + j + place[better]]
        return (best.reshape(-1), words) if where else best.reshape(-1)

    def top(self, maxima: np.ndarray) -> np.ndarray:
        """Logits of texts by their filters' maxima."""
        _, bias, out = self.views(self.small)
        return (np.maximum(maxima + bias, 0) * out).sum(axis=1) + self.small[-1]

    def scores_of(self, logits: np.ndarray, languages: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        shift = np.array([self.shift.get(name, self.shift.get("all", 0.0)) for name in languages])
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) - shift, -60, 60)))

    def logits(self, docs: list[list[str]]) -> np.ndarray:
        return Reader(self).read(docs)[0]

    def scores(self, docs: list[list[str]]) -> np.ndarray:
        return self.scores_of(*Reader(self).read(docs))

    def forget_rare(self, seen: np.ndarray) -> None:
        """``seen``: in how many labelled texts each hashed row occurs."""
        self.known = seen >= LEAST_TEXTS
        self.table[~self.known] = 0

    def step(self, docs: list[np.ndarray], labels: np.ndarray, lexicon: Lexicon) -> None:
        """One step of descent (Adagrad) on a few texts, given as numbers of ``lexicon``."""
        mark = np.zeros(len(lexicon) + 1, bool)
        for d in docs:
            mark[d] = True
        own = np.flatnonzero(mark)
        local = np.zeros(len(mark), np.int32)
        local[own] = np.arange(1, len(own) + 1)
        rows = lexicon.rows(own)
        emb = np.concatenate([np.zeros((1, DIM), np.float32), self.table[rows].mean(axis=1)])
        filters, bias, out = self.views(self.small)
        projected = [[emb @ f for f in places] for places in filters]
        found = [self.maxima(local[d], projected, where=True) for d in docs]
        hidden = np.maximum(np.array([best for best, _ in found]) + bias, 0)
        words = np.array([w for _, w in found])
        p = 1 / (1 + np.exp(-np.clip(hidden @ out + self.small[-1], -30, 30)))
        err = ((p - labels) / len(docs)).astype(np.float32)
        d_hidden = err[:, None] * out * (hidden > 0)
        d_small, d_emb = np.zeros_like(self.small), np.zeros_like(emb)
        d_filters, d_bias, d_out = self.views(d_small)
        d_bias[:], d_out[:], d_small[-1] = d_hidden.sum(axis=0), hidden.T @ err, err.sum()
        for k, width in enumerate(WIDTHS):
            g = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                word = words[:, k, :, j]
                d_filters[k][j][:] = np.einsum("bfd,bf->df", emb[word], g)
                np.add.at(d_emb, word.reshape(-1), (g[:, :, None] * filters[k][j].T[None]).reshape(-1, DIM))
        self.g_small += d_small**2
        self.small -= RATE * d_small / np.sqrt(self.g_small)
        touched = np.flatnonzero(np.abs(d_emb[1:]).sum(axis=1) > 0)
        at, grad = rows[touched].reshape(-1), np.repeat(d_emb[1:][touched] / 4, 4, axis=0)
        at, grad = at[self.known[at]], grad[self.known[at]]
        np.add.at(self.g_table, at, (grad**2).mean(axis=1))
        np.add.at(self.table, at, -RATE * grad / np.sqrt(self.g_table[at])[:, None])

    def go_through(self, texts: Iterable[tuple[list[str], int]], epochs: int = 1, seed: int = 11) -> None:
        """Steps over ``(words, label)`` in the given order, or ``epochs`` times over all of them in changing orders."""
        if epochs > 1:
            lexicon = Lexicon()
            held = [(lexicon.numbers(words), label) for words, label in texts]
            rng = np.random.default_rng(seed)
            for _ in range(epochs):
                order = rng.permutation(len(held))
                for b in range(0, len(order), BATCH):
                    pick = [held[i] for i in order[b : b + BATCH]]
                    self.step([d for d, _ in pick], np.array([y for _, y in pick]), lexicon)
            return
        lexicon, pick = Lexicon(), []
        for words, label in texts:
            pick.append((lexicon.numbers(words), label))
            if len(pick) == BATCH:
                self.step([d for d, _ in pick], np.array([y for _, y in pick]), lexicon)
                lexicon, pick = Lexicon() if len(lexicon) > MOST_WORDS else lexicon, []
        if pick:
            self.step([d for d, _ in pick], np.array([y for _, y in pick]), lexicon)


class Reader:
    """A finished network at work: keeps what its filters make of the words met so far, and starts anew at MOST_WORDS words."""

    def __init__(self, net: Network):
        self.net = net
        self.lexicon, self.done, self.projected = Lexicon(), 0, [[np.zeros((1, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]

    def read(self, docs: Iterable[list[str]]) -> tuple[np.ndarray, list[str]]:
        """The texts' logits and languages."""
        maxima, languages = [], []
        for words in docs:
            if len(self.lexicon) > MOST_WORDS:
                self.__init__(self.net)
            numbers = self.lexicon.numbers(words)
            self._meet()
            maxima.append(self.net.maxima(numbers, self.projected))
            languages.append(self.lexicon.guess(numbers))
        return self.net.top(np.array(maxima, np.float32).reshape(-1, len(WIDTHS) * FILTERS)), languages

    def _meet(self) -> None:
        low, high = self.done + 1, len(self.lexicon) + 1
        if low == high:
            return
        if high > len(self.projected[0][0]):
            self.projected = [[np.concatenate([p, np.zeros((high, FILTERS), np.float32)]) for p in places] for places in self.projected]
        for places, news in zip(self.projected, self.net.projected(self.lexicon.rows(slice(low, high))), strict=True):
            for p, new in zip(places, news, strict=True):
                p[low:high] = new
        self.done = high - 1


def texts_with_rows(docs: Iterable[list[str]]) -> np.ndarray:
    """In how many texts each hashed row occurs."""
    seen, lexicon = np.zeros(BUCKETS, np.int64), Lexicon()
    for words in docs:
        numbers = np.unique(lexicon.numbers(words))
        seen[np.unique(lexicon.rows(numbers))] += 1
        if len(lexicon) > MOST_WORDS:
            lexicon = Lexicon()
    return seen


def epochs_for(texts: int) -> int:
    """A small table is gone through more often, so that the number of steps stays about the same."""
    return int(np.clip(VISITS // max(texts, 1), 1, MOST_EPOCHS))


def fit(docs: list[list[str]], labels: np.ndarray) -> Network:
    """The network of a few texts at hand, which teach weights and threshold alike; ``learn`` is for tables."""
    net = Network()
    net.forget_rare(texts_with_rows(docs))
    net.go_through(zip(docs, labels, strict=True), epochs_for(len(docs)))
    logits = net.logits(docs)
    edges = np.unique(logits)
    edges = (edges[1:] + edges[:-1]) / 2
    errors = [((logits > e) != (labels == 1)).sum() for e in edges]
    net.shift["all"] = float(edges[np.argmin(errors)]) if len(edges) else 0.0
    return net


def thresholds(logits: DataFrame, keep) -> dict[str, float]:
    """A logit threshold by language and over all: the middle of the gap with the fewest errors, of several the widest.

    ``logits`` is (name, logit, label). The running counts are taken over cells of a sixteenth first, then within each.
    """
    each = logits.select(F.explode(F.array(F.lit("all"), "name")).alias("name"), "logit", "label")
    ones, zeros = F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))
    cell = F.floor(F.least(F.greatest(F.col("logit") * 16, F.lit(-1024.0)), F.lit(1024.0)))
    counts = keep(each.groupBy("name", "logit").agg(ones.alias("n1"), zeros.alias("n0")).withColumn("cell", cell))
    # at most 2049 cells a language
    over = Window.partitionBy("name").orderBy("cell")
    before, whole = over.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("name")
    cells = counts.groupBy("name", "cell").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.min("logit").alias("low"))
    cells = cells.select("name", "cell", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before{n}") for n in ("n1", "n0")), *(F.sum(n).over(whole).alias(f"all{n}") for n in ("n1", "n0")), F.lead("low").over(over).alias("following"))
    within = Window.partitionBy("name", "cell").orderBy("logit")
    placed = counts.join(F.broadcast(keep(cells)), ["name", "cell"]).where(F.least("alln1", "alln0") > 0)
    missed, right = (F.col(f"before{n}") + F.sum(n).over(within) for n in ("n1", "n0"))
    after = F.coalesce(F.lead("logit").over(within), F.col("following"), F.col("logit") + 2)
    gaps = placed.select("name", "logit", "alln1", "alln0", missed.alias("missed"), right.alias("right"), after.alias("after"))
    cost = F.col("missed") + F.col("alln0") - F.col("right")
    best = F.min(F.struct(cost.alias("cost"), (F.col("logit") - F.col("after")).alias("width"), ((F.col("logit") + F.col("after")) / 2).alias("edge")))
    least = gaps.groupBy("name").agg(best.alias("best"), F.first("alln1").alias("n1"), F.first("alln0").alias("n0")).collect()
    return {r["name"]: r["best"]["edge"] for r in least if r["name"] == "all" or min(r["n1"], r["n0"]) >= LEAST}


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, fold: int, folds: int) -> DataFrame:
    """``(place, label, text)``: every text that a label outside the held-out fold belongs to; place is a hash."""
    own = labels.where(~held_out(fold, folds) & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))  # a doc_id of both labels counts as 1
    # a sieve of at most 2**20 rows, 64 bits each, keeps most texts without a label out of the shuffle
    word, bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 1), 64) as int))")
    sieve = own.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(sieve), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "text")
    both = texts.hint("shuffle_hash").join(own.hint("shuffle_hash"), "doc_id")
    return both.select(F.xxhash64("doc_id", "text").alias("place"), "label", "text")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], int]]:
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            yield words_of(text.as_py()), label.as_py()


_ROW = "block int, at binary, value binary"


def _sums(rows: DataFrame, width: int) -> np.ndarray:
    """The sums of ``(block, at, value)`` rows, each some places of a block and ``width`` whole numbers for each, of which the last isn't 0."""
    size = BUCKETS // BLOCKS

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = total.setdefault(block, np.zeros((size, width), np.int64))
                own[np.frombuffer(at, np.int32)] += np.frombuffer(value, np.int64).reshape(-1, width)
        for block, own in total.items():
            at = np.flatnonzero(own[:, -1])
            yield from _blocks(block * size + at, own[at])

    out = np.zeros((BUCKETS + size, width), np.int64)
    for r in rows.repartition(BLOCKS, "block").mapInArrow(add, _ROW).collect():  # 43 MB at most, set by BUCKETS and DIM
        out[r["block"] * size + np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.int64).reshape(-1, width)
    return out


def _blocks(at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for ``_sums`` of whole numbers at ascending places."""
    size = BUCKETS // BLOCKS
    for block in np.unique(at // size):
        own = at // size == block
        value = pa.array([np.ascontiguousarray(values[own], np.int64).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(at[own] % size).astype(np.int32).tobytes()], pa.binary()), value], ["block", "at", "value"])


def count_rows(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each hashed row occurs."""

    def run(batches):
        seen = texts_with_rows(words for words, _ in _texts(batches))
        at = np.flatnonzero(seen)
        yield from _blocks(at, seen[at, None])

    return _sums(texts.select("text", "label").mapInArrow(run, _ROW), 1)[:BUCKETS, 0]


def one_round(net: Network, texts: DataFrame, parts: int, epochs: int) -> None:
    """Each part goes on from ``net`` through its texts; then ``net`` takes the average of what they changed."""
    shared = texts.sparkSession.sparkContext.broadcast(net)  # 18 MB, set by BUCKETS and DIM

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        old, new = shared.value, Network()
        for name in ("table", "small", "g_table", "g_small"):
            setattr(new, name, getattr(old, name).copy())
        new.known = old.known
        new.go_through(_texts(b for group in ([first], batches) for b in group), epochs)
        learned = (new.g_table - old.g_table).astype(np.float64)
        at = np.flatnonzero(learned)
        changed = (new.table[at].astype(np.float64) - old.table[at]) * learned[at, None]
        yield from _blocks(at, np.rint(np.concatenate([changed, learned[at, None], np.ones((len(at), 1)) / UNIT], axis=1) * UNIT))
        # what is small lies behind the table, with the same width
        small = np.zeros((len(new.small), DIM + 2))
        small[:, 0], small[:, DIM], small[:, DIM + 1] = new.small.astype(np.float64) - old.small, new.g_small.astype(np.float64) - old.g_small, 1 / UNIT
        yield from _blocks(BUCKETS + np.arange(len(small)), np.rint(small * UNIT))

    own = texts.repartition(parts, F.pmod(F.shiftright("place", 20), F.lit(parts))).sortWithinPartitions("place", "text", "label")
    sums = _sums(own.select("text", "label").mapInArrow(run, _ROW), DIM + 2)
    shared.unpersist()
    at = np.flatnonzero(sums[:BUCKETS, DIM])
    net.table[at] += (sums[at, :DIM] / sums[at, DIM, None]).astype(np.float32)
    net.g_table[at] += (sums[at, DIM] / UNIT / sums[at, DIM + 1]).astype(np.float32)
    small = sums[BUCKETS : BUCKETS + len(net.small)]
    net.small += (small[:, 0] / UNIT / small[:, DIM + 1]).astype(np.float32)
    net.g_small += (small[:, DIM] / UNIT / small[:, DIM + 1]).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, column: str, fold: int, folds: int) -> Network:
    """The network of all labelled texts outside the held-out fold."""
    net = Network()
    with scratch(docs.sparkSession) as keep:
        texts = keep(labelled_texts(docs, labels, column, fold, folds).withColumn("last", F.pmod("place", F.lit(FOLDS)) == FOLDS - 1))
        sizes = {(r["last"], r["label"]): r for r in texts.groupBy("last", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
        n = lambda last, label: sizes[last, label]["n"] if (last, label) in sizes else 0
        ones, zeros = n(False, 1) + n(True, 1), n(False, 0) + n(True, 0)
        if min(ones, zeros) < 2:
            net.constant = (ones + 1) / (ones + zeros + 2)
            return net
        net.forget_rare(count_rows(texts))
        taught, rest = texts.where("not last"), texts.where("last")
        if (count := n(False, 0) + n(False, 1)) <= VISITS and sum(r["chars"] for r in sizes.values()) <= VISIT_CHARS:
            one_round(net, taught, 1, epochs_for(count))
        else:
            parts = -(-count // (ROUNDS * TURN_DOCS))
            turn = F.pmod(F.shiftright("place", 8), F.lit(ROUNDS))
            for k in range(ROUNDS):
                one_round(net, taught.where(turn == k), parts, 1)
        # where the fifth holds too few of a class, all of them are asked
        return calibrated(net, rest if min(n(True, 0), n(True, 1)) >= LEAST else texts, keep)


def calibrated(net: Network, texts: DataFrame, keep) -> Network:
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            logits, names = reader.read(map(words_of, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(logits.astype(np.float64)), batch.column(1)], ["name", "logit", "label"])

    net.shift = thresholds(texts.select("text", "label").mapInArrow(run, "name string, logit double, label int"), keep)
    shared.unpersist()
    return net


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, "toxic", 0, 5))  # 18 MB, set by BUCKETS and DIM

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            scores = reader.net.scores_of(*reader.read(words_of(t.as_py()) for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher is more toxic), predicted (1 if score >= 0.5)."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
