"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Every line that is not white space alone takes part, whole. Its character shingles are the SHINGLE
characters from each character on, of the lower-cased line (a line shorter than that is, trimmed,
its own shingle). Equal lines are counted as one. Distinct lines lie in a table bucketed by their
64-bit hash, which names them, so that texts are fetched for signatures and checks without being
shuffled again. Each gets BANDS x ROWS minima of its shingles' hashes; lines that agree on all rows
of a band are candidates: in groups of up to SMALL lines all pairs, in larger ones each line with the
group's pivot, its most frequent line. Candidates whose sketches, one bit for every residue of their shingles, differ in
more bits than such lines can are out; the others are verified by the exact Jaccard similarity of
their whole shingle sets (shingles as 64-bit hashes), verified links are joined into components, and of
each component's occurrences the first, by (doc_id, text hash, line number), stays.

A larger group whose lines are then in one component has nothing left to find. In any other, those
lines of different components are verified whose sketches, one parity bit for every residue of their
shingles, differ in no more bits than the shingles of such lines can. So no partner in a crowded group is left out.

A pair at similarity 0.8 shares one of eight bands of three rows with probability 0.997. Nulls: a null text has no lines; documents with a
null doc_id stay as they are and take no part. Rows of one doc_id and different texts are different
documents; rows that repeat both share their decisions. Other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlight.llm.tables import column, fresh, table
from spendlight.operators.components import connected_components
from spendlight.storage import bucketed, scratch, store

BANDS, ROWS, SHINGLE, SIMILARITY = 8, 3, 12, 0.8
#: Distinct lines of a group up to which all its pairs are compared.
SMALL = 8
#: Parts that a line's partners in a crowded group are dealt into.
PARTS = 16
#: Words of 64 bits in the sketch of a line's shingles.
WORDS = 16
#: Shingles in a row of hashes for the minima, and for sketches, whose code is longer (the JVM compiles no method of over 8,000 bytes).
CHUNK, MARKED = 24, 16
WHITE = " \t\r\x0b\x0c"


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, place, line)`` for every line that is not white space alone; version is the text's hash."""
    text = F.col("text").cast("string")
    parts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    parts = parts.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return parts.where(F.ltrim("line", F.lit(WHITE)) != "")


def _last(line):
    """Number of a line's last shingle."""
    return F.greatest(F.length(F.lower(line)) - SHINGLE, F.lit(0))


def _wide(line):
    """A line, lower-cased, with four bytes for each character, so that any of its shingles is found at once; a shorter one than a shingle is that shingle."""
    own = F.when(F.length(F.lower(line)) < SHINGLE, F.trim(F.lower(line), F.lit(WHITE)))
    return F.coalesce(own.cast("binary"), F.encode(F.lower(line), "UTF-32"))


def _at(wide, byte):
    """The 64-bit hash of the shingle that begins at ``byte``, counted from 1."""
    return F.xxhash64(F.substring(wide, byte, F.lit(4 * SHINGLE)))


def _bytes(line, step: int):
    """Where every ``step``-th shingle begins."""
    return F.sequence(F.lit(1), _last(line) * 4 + 1, F.lit(4 * step))


def shingles(line):
    """The 64-bit hashes of a line's shingles, repeats included."""
    # the line is widened once, for all of them
    return F.transform(F.array(_wide(line)), lambda wide: F.transform(_bytes(line, 1), lambda byte: _at(wide, byte)))[0]


def _top(x: int, shift: int) -> int:
    """``x`` as the top bits of a signed 64-bit number."""
    x <<= shift
    return x - (1 << 64) if x >= 1 << 63 else x


def _hashed(texts: DataFrame, chunk: int) -> DataFrame:
    """``(h, n, x0, ...)``: the hashes of up to ``chunk`` shingles a row, n of them; past the line's end, its last shingle is taken again."""
    # in steps: beside an explode, expressions are evaluated once for each row it makes
    one = texts.select("h", _wide("line").alias("wide"), _bytes("line", chunk).alias("every"))
    one = one.select("h", "wide", F.explode("every").alias("byte"))
    one = one.select("h", F.substring("wide", F.col("byte"), F.lit(4 * (SHINGLE + chunk - 1))).alias("part"))
    one = one.select("h", "part", F.greatest(F.length("part") - 4 * SHINGLE + 1, F.lit(1)).alias("last"))
    places = (F.least(F.lit(4 * j + 1), "last") for j in range(chunk))
    return one.select("h", F.shiftright(F.col("last") + 3, 2).alias("n"), *(_at("part", place).alias(f"x{j}") for j, place in enumerate(places)))


def minima(texts: DataFrame, count: int) -> DataFrame:
    """``(h, m0, ...)``: ``count`` minima of each line's shingle hashes, a row per CHUNK shingles in between.

    The orders differ by a mask of the hash's top five bits (up to 32 masks), so that each finds the hash
    nearest to another place. The least of a row's hashes under each mask comes first: a line's minima
    are then looked up and updated once a row and not once a shingle.
    """
    masks = [F.lit(_top(k * 11 % 32, 59)) for k in range(count)]
    return _hashed(texts, CHUNK).groupBy("h").agg(*(F.min(F.least(*(F.col(f"x{j}").bitwiseXOR(mask) for j in range(CHUNK)))).alias(f"m{k}") for k, mask in enumerate(masks)))


def _marks(texts: DataFrame) -> DataFrame:
    """``(h, n, s0, ...)``: bit i tells whether any of a line's n shingles falls on it."""
    word, bit = (lambda x: x.bitwiseAND(F.lit(WORDS - 1))), (lambda j: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x{j}, 58) as int))"))
    either = lambda w: reduce(lambda one, two: one.bitwiseOR(two), (F.when(word(F.col(f"x{j}")) == w, bit(j)).otherwise(F.lit(0).cast("long")) for j in range(MARKED)))
    return _hashed(texts, MARKED).groupBy("h").agg(F.sum("n").alias("n"), *(F.bit_or(either(w)).alias(f"s{w}") for w in range(WORDS)))


def signatures(texts: DataFrame) -> DataFrame:
    """``(h, keys)``: the band keys of each distinct line."""
    keys = (F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS))
    return minima(texts, BANDS * ROWS).select("h", F.array(*keys).alias("keys"))


def _differing(a: str, b: str):
    """Number of bits in which two sketches, of columns s0_a and so on, differ."""
    return sum((F.bit_count(F.col(f"s{w}_{a}").bitwiseXOR(F.col(f"s{w}_{b}"))) for w in range(1, WORDS)), F.bit_count(F.col(f"s0_{a}").bitwiseXOR(F.col(f"s0_{b}"))))


def _within(differing, both):
    """Whether sets of ``both`` shingles together can reach SIMILARITY if ``differing`` of them or more are in one alone."""
    # a similarity of s leaves at most (1 - s) / (1 + s) of both sizes to differ; a hair more is let through
    return differing <= (1 - SIMILARITY) / (1 + SIMILARITY) * both + 1e-6


def sifted(pairs: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """The ``pairs`` (a, b) that can reach SIMILARITY: a bit that one line's shingles mark and the other's don't stands for at least one shingle of its own."""
    marks = keep(_marks(texts))
    side = lambda name: marks.select(*(F.col(c).alias(name if c == "h" else f"{c}_{name}") for c in marks.columns)).hint("merge")
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return both.where(_within(_differing("a", "b"), F.col("n_a") + F.col("n_b"))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets' Jaccard similarity reaches SIMILARITY; ``texts`` is (h, line)."""
    pairs = keep(pairs)
    # the ends are looked up by hash, so that the texts needn't be sorted
    ends = keep(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().hint("shuffle_hash").join(texts, "h").select("h", "line"))
    pairs = keep(sifted(pairs, ends, keep))
    both = pairs.hint("merge").join(ends.select(F.col("h").alias("a"), F.col("line").alias("la")).hint("merge"), "a")
    both = both.hint("merge").join(ends.select(F.col("h").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
    # generated, so that each list is computed once and the condition isn't pushed to where they are made
    lists = both.select("a", "b", F.inline(F.array(F.struct(shingles("la").alias("sa"), shingles("lb").alias("sb")))))
    sizes = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    return keep(lists.where(sizes[0] >= SIMILARITY * sizes[1]).select("a", "b"))


def _candidates(members: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of groups of up to SMALL lines, and each line of a larger one with the pivot; ``members`` is (key, h, n, size)."""
    small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
    one, two = small.select("key", F.col("h").alias("a")), small.select("key", F.col("h").alias("b"))
    pairs = one.hint("merge").join(two.hint("merge"), "key").where("a < b").select("a", "b")
    pivots = large.groupBy("key").agg(F.max(F.struct("n", "h")).alias("pivot")).select("key", F.col("pivot.h").alias("b"))
    stars = large.select("key", F.col("h").alias("a")).hint("merge").join(pivots.hint("merge"), "key").where("a != b").select("a", "b")
    return pairs.union(stars).distinct()


def _open(members: DataFrame, joined: DataFrame, keep) -> DataFrame:
    """``(key, h, component)``: the groups of more than SMALL lines that aren't in one component, whole."""
    large = members.where(F.col("size") > SMALL).select("key", "h")
    named = keep(large.hint("merge").join(joined.hint("merge"), "h", "left").select("key", "h", F.coalesce("component", "h").alias("component")))
    several = keep(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    return keep(named.hint("merge").join(several.hint("merge"), "key"))


def _sketched(lines: DataFrame) -> DataFrame:
    """``(h, component, size, s0, ...)``: bit i of the sketch tells whether an odd number of a line's shingles fall on it."""
    each = lines.select("h", "component", F.explode("set").alias("x"))
    word, bit = F.col("x").bitwiseAND(F.lit(WORDS - 1)), F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 58) as int))")
    return each.groupBy("h", "component").agg(F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(WORDS)))


def _rest(open_: DataFrame, texts: DataFrame, keep) -> DataFrame:
    """The pairs of a group's lines of different components that can be alike; one side is dealt into parts, the other sent to each.

    Each shingle that one of two lines has and the other hasn't changes one bit of their sketches' difference, so that
    this has at most as many bits as there are such shingles; of lines that reach SIMILARITY, at most a share of both sizes.
    """
    lines = keep(open_.select("h", "component").distinct())
    # written out, lest the set be computed for every text to see whether it is empty
    sets = keep(lines.hint("shuffle_hash").join(texts, "h").select("h", "component", F.array_distinct(shingles("line")).alias("set")))
    sketches = keep(_sketched(sets))
    members = keep(open_.select("key", "h").hint("merge").join(sketches.hint("merge"), "h"))
    part = F.pmod(F.xxhash64("h"), F.lit(PARTS)).cast("int")
    side = lambda name, parts: members.select("key", F.col("h").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("component", "size", *(f"s{w}" for w in range(WORDS)))), parts.alias("part"))
    one, two = side("a", part), side("b", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    alike = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & _within(_differing("a", "b"), F.col("size_a") + F.col("size_b"))
    return one.hint("merge").join(two.hint("merge"), ["key", "part"]).where(alike).select("a", "b").distinct()


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("id").alias("h"), "component")


def _joined_further(joined: DataFrame, found: DataFrame, keep) -> DataFrame:
    """``joined`` (h, component) with the further links ``found``, which join components or single lines."""
    ends = keep(joined.union(found.select(F.explode(F.array("a", "b")).alias("h")).select("h", F.col("h").alias("component"))).groupBy("h").agg(F.min("component").alias("component")))
    one, two = ends.select(F.col("h").alias("a"), F.col("component").alias("ca")), ends.select(F.col("h").alias("b"), F.col("component").alias("cb"))
    between = found.hint("merge").join(one.hint("merge"), "a").hint("merge").join(two.hint("merge"), "b").select("ca", "cb")
    more = connected_components(between, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("root"))
    return keep(ends.hint("merge").join(more.hint("merge"), "component", "left").select("h", F.coalesce("root", "component").alias("component")))


def components_of(texts: DataFrame, keep) -> DataFrame:
    """``(h, component)`` for each of the distinct lines ``texts`` (h, n, line) that is linked to another; component is the least h."""
    signed = keep(signatures(texts))
    filed = signed.select("h", F.explode("keys").alias("key"))
    # sized where they meet: most keys are of one line, and go at once
    sized = keep(filed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1"))
    # a group of two is its least and its greatest line
    twos = sized.where("size = 2").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).select("a", "b")
    members = keep(sized.where("size > 2").hint("merge").join(texts.select("h", "n").hint("merge"), "h"))
    texts = texts.select("h", "line")
    joined = _components(verified(twos.union(_candidates(members)).distinct(), texts, keep))
    open_ = _open(members, joined, keep)
    if open_.isEmpty():
        return joined
    few = keep(open_.select("h").distinct().hint("shuffle_hash").join(texts, "h"))
    return _joined_further(joined, verified(_rest(open_, few, keep), few, keep), keep)


def removed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, version, places)``: the line numbers, ascending, that a near-duplicate before them makes redundant."""
    lines = lines_of(docs).withColumn("h", F.xxhash64("line"))
    distinct = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("line").alias("line"))
    with scratch(docs.sparkSession) as keep, bucketed(distinct, "h") as texts:
        joined = components_of(texts, keep)
        repeated = texts.where("n > 1").select("h", F.col("h").alias("component"))
        # a repeated line that also has links carries its component, which is never larger than its own hash
        roots = keep(joined.union(repeated).groupBy("h").agg(F.min("component").alias("root")))
        return _redundant(lines, roots, keep)


def _redundant(lines: DataFrame, roots: DataFrame, keep) -> DataFrame:
    placed = keep(lines.select("doc_id", "version", "place", "h").hint("merge").join(roots.hint("merge"), "h").select("root", F.struct("doc_id", "version", "place").alias("at")))
    first = keep(placed.groupBy("root").agg(F.min("at").alias("first")))
    gone = placed.hint("merge").join(first.hint("merge"), "root").where(F.col("at") != F.col("first"))
    return store(gone.groupBy("at.doc_id", "at.version").agg(F.sort_array(F.collect_set("at.place")).alias("places")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with each text's redundant lines taken out; no row goes."""
    version, places = fresh(docs, "version"), fresh(docs, "places")
    gone = removed_lines(docs).withColumnRenamed("version", version).withColumnRenamed("places", places)
    text = F.col("text").cast("string")
    both = docs.withColumn(version, F.xxhash64(text)).hint("merge").join(gone.hint("merge"), ["doc_id", version], "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(places, i)), "\n")
    new = F.when(F.col(places).isNull(), F.col("text")).otherwise(kept)
    return both.select(*(new.alias(c) if c == "text" else column(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (all lines), n_removed, removed (line numbers from 0, ascending)."""
    docs = table(spark, sf_dir, "documents")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    slim = docs.select("doc_id", F.xxhash64("text").alias("version"), n_lines.alias("n_lines"))
    removed = F.coalesce("places", F.array().cast("array<int>"))
    both = slim.hint("merge").join(removed_lines(docs).hint("merge"), ["doc_id", "version"], "left")
    return both.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))
