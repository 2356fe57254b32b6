"""Joining texts with the names they contain, anywhere in a word or beside any sign, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlight.storage import store

#: Letters at each end of a name by which places of a text are sifted; shorter names are looked up whole.
END = 3
#: Bounds of the two lists that are sent to every task: hashed beginnings, and hashed beginnings with length and end.
STARTS, SHAPES = 1 << 16, 1 << 18


def _wide(text: str) -> Column:
    """The text in four bytes a letter, so that any run of it is cut out at once."""
    return F.encode(text, "UTF-32")


def _run(wide: Column | str, start: Column, n: Column) -> Column:
    """``n`` letters of a wide text from the letter ``start`` (from 0) on."""
    return F.substring(wide, start * 4 + 1, n * 4)


def _start(wide: Column | str, at: Column) -> Column:
    return F.pmod(F.xxhash64(_run(wide, at, F.lit(END))), F.lit(STARTS)).cast("int")


def _shape(start: Column, wide: Column | str, at: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(start, n, _run(wide, at + n - END, F.lit(END))), F.lit(SHAPES)).cast("int")


def _sifted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of texts with ``at__`` and ``n__``: runs that begin, end and are as long as some name of ``END`` letters or more."""
    n = (F.length("wide__") / 4).cast("int")
    shaped = names.withColumn("n__", n).withColumn("start__", _start("wide__", F.lit(0))).withColumn("shape__", _shape(F.col("start__"), "wide__", F.lit(0), F.col("n__")))
    starts = store(shaped.groupBy("start__").agg(F.collect_set("n__").alias("sizes__")))
    shapes = store(shaped.select("shape__").distinct())
    each = texts.where(n >= END).select("*", F.explode(F.sequence(F.lit(0), n - END)).alias("at__")).withColumn("start__", _start("wide__", F.col("at__")))
    sized = each.join(F.broadcast(starts), "start__").select("*", F.explode("sizes__").alias("n__")).where(F.col("at__") + F.col("n__") <= n)
    return sized.withColumn("shape__", _shape(F.col("start__"), "wide__", F.col("at__"), F.col("n__"))).join(F.broadcast(shapes), "shape__", "left_semi")


def _places(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``(text_hash__, name_hash__)`` of the runs of ``_sifted``."""
    return _sifted(texts, names).select("text_hash__", F.xxhash64(_run("wide__", F.col("at__"), F.col("n__"))).alias("name_hash__"))


def _sifted_short(texts: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """The same of runs of ``n`` letters, whole, for names shorter than ``END``."""
    hashed = lambda at: F.pmod(F.xxhash64(_run("wide__", at, F.lit(n))), F.lit(SHAPES)).cast("int")
    last = (F.length("wide__") / 4).cast("int") - n
    shapes = store(names.where(F.length("wide__") == 4 * n).select(hashed(F.lit(0)).alias("shape__")).distinct())
    each = texts.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last)).alias("at__"), F.lit(n).alias("n__"))
    return each.withColumn("shape__", hashed(F.col("at__"))).join(F.broadcast(shapes), "shape__", "left_semi")


def _short_places(texts: DataFrame, n: int) -> DataFrame:
    """The same of all runs of ``n`` letters, each once a text."""
    last = (F.length("wide__") / 4).cast("int") - n
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda at: F.xxhash64(_run("wide__", at, F.lit(n)))))
    return texts.where(last >= 0).select("text_hash__", F.explode(runs).alias("name_hash__"))


def contained(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of ``texts`` and ``names`` side by side where the text contains the name, letter for letter.

    Texts and names are known by hash while they are met, and a text meets a name by the hash of the whole name. Only
    runs of a text that begin and end like some name of their length are hashed, so that what is exchanged is little
    more than the matches. The texts themselves are joined to the names they contain once, at the end. Null and
    empty names meet nothing.
    """
    wide_texts = texts.where(F.length(text) > 0).select(F.xxhash64(text).alias("text_hash__"), _wide(text).alias("wide__"))
    known = store(names.where(F.length(name) > 0).select(F.xxhash64(name).alias("own_hash__"), _wide(name).alias("wide__")).distinct())
    size = F.length("wide__") / 4
    most, *short = known.agg(F.max(size), *(F.max(size == n) for n in range(1, END))).first()
    places = [_short_places(wide_texts, n) for n, there in zip(range(1, END), short) if there]
    if (most or 0) >= END or not places:
        places.append(_places(wide_texts, known.where(size >= END)))
    placed = places[0]
    for more in places[1:]:
        placed = placed.unionByName(more)
    hashed = known.select("own_hash__", F.xxhash64("wide__").alias("name_hash__"))
    met = store(placed.hint("merge").join(hashed.hint("merge"), "name_hash__").select("text_hash__", "own_hash__").distinct())
    keyed = texts.withColumn("text_hash__", F.xxhash64(text)).hint("merge").join(met.hint("merge"), "text_hash__")
    both = keyed.hint("merge").join(names.withColumn("own_hash__", F.xxhash64(name)).hint("merge"), "own_hash__")
    return both.where(F.contains(text, name)).drop("text_hash__", "own_hash__")


def named(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """As ``contained``, for texts whose other columns are slim: the rows of both without the text, each pair of rows once.

    A run that begins and ends like some name of its length goes to the names itself, beside its row's other columns, and
    meets them letter for letter. So each match is exchanged once, nothing has to be verified and no text leaves its task.
    """
    own = [c for c in texts.columns if c != text]
    whole = texts.where(F.length(text) > 0).withColumn(text, F.make_valid_utf8(text)).withColumn("wide__", _wide(text))
    known = store(names.where(F.length(name) > 0).select(_wide(name).alias("wide__")).distinct())
    size = F.length("wide__") / 4
    most, *short = known.agg(F.max(size), *(F.max(size == n) for n in range(1, END))).first()
    places = [_sifted_short(whole, known, n) for n, there in zip(range(1, END), short) if there]
    if (most or 0) >= END or not places:
        places.append(_sifted(whole, known.where(size >= END)))
    run = F.substring(F.col(text), F.col("at__") + 1, F.col("n__"))
    # a name that the text repeats counts where it is first
    firsts = [p.select(*own, text, "at__", run.alias(name)).where(F.position(F.col(name), F.col(text)) == F.col("at__") + 1).select(*own, name) for p in places]
    met = firsts[0]
    for more in firsts[1:]:
        met = met.unionByName(more)
    return met.hint("merge").join(names.where(F.length(name) > 0).hint("merge"), name)
