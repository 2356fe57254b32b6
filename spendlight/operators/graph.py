"""Entity graph: co-occurrence edges, centrality, bounded traversal and motifs, as joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendlight.functions.text import mask_mention
from spendlight.operators.ranking import ranked
from spendlight.storage import cut, spread, store


def cooccurrence(mentions: DataFrame, max_entities: int | None = None) -> DataFrame:
    """``(artifact_id, a, b, context)``: unordered pairs of distinct entities of an artifact, first context masked.

    ``max_entities`` bounds an artifact's entities; ``crowded_artifacts`` lists what that leaves out.
    """
    first = spread(mentions.where(F.col("entity_id").isNotNull()), "artifact_id").groupBy("artifact_id", "entity_id").agg(F.min_by("raw_text", "mention_id").alias("raw_text"))
    if max_entities is not None:
        first = first.join(crowded_artifacts(mentions, max_entities), "artifact_id", "left_anti")
    one, two = first.select("artifact_id", F.col("entity_id").alias("a"), F.col("raw_text").alias("context")), first.select("artifact_id", F.col("entity_id").alias("b"))
    return one.join(two, "artifact_id").where("a < b").select("artifact_id", "a", "b", mask_mention(F.col("context")).alias("context"))


def crowded_artifacts(mentions: DataFrame, max_entities: int) -> DataFrame:
    return mentions.groupBy("artifact_id").agg(F.countDistinct("entity_id").alias("n")).where(F.col("n") > max_entities).select("artifact_id")


def edges_from_pairs(pairs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New pairs at 0.6, a tenth more for each further artifact, 1 at most; existing edges gain a tenth for each."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("artifact_id").alias("provenance"))
    if existing is None:
        return counted.select("a", "b", F.lit("affiliated_with").alias("rel_type"), F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("n") - 1)).alias("confidence"), "provenance")
    old = existing.select("a", "b", F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5)).alias("old"))
    value = F.when(F.col("old").isNull(), F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("n") - 1))).otherwise(F.least(F.lit(1.0), F.col("old") + 0.1 * F.coalesce("n", F.lit(0))))
    return counted.join(old, ["a", "b"], "full").select("a", "b", F.lit("affiliated_with").alias("rel_type"), value.alias("confidence"), "provenance")


def _ends(edges: DataFrame) -> DataFrame:
    loops = F.when(F.col("source") == F.col("target"), F.array("source")).otherwise(F.array("source", "target"))
    return edges.select(F.explode(loops).alias("id"), "confidence")


def undirected(edges: DataFrame) -> DataFrame:
    weight = (1 - F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(0.5))).alias("weight")
    return edges.select(F.col("source").alias("x"), F.col("target").alias("y"), weight).unionByName(edges.select(F.col("target").alias("x"), F.col("source").alias("y"), weight))


def degree_centrality(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges at either end (a self-loop once) over the number of entities."""
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    counts = _ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ids.join(counts, "id", "left").crossJoin(F.broadcast(total)).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) / F.col("total")).alias("centrality"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ``ids``."""
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def count_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return subgraph(edges, ids).agg(F.count(F.lit(1)).alias("n"))


def neighborhood(seeds: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int = 100) -> DataFrame:
    """``(seed, node, depth)``: nodes at most ``depth`` hops away, the first ``max_nodes`` of each seed by depth, then id.

    A seed's budget is spent level by level: what no longer fits is never opened. Of a node's neighbours the least
    ``2 * max_nodes`` are kept, since no more than ``max_nodes`` of them can be known already; a hub's list is cut over several partitions.
    """
    both = undirected(edges).select("x", "y").where("x is not null and y is not null and x <> y").distinct()
    near = cut(ranked(both, "x", [F.col("y")]).where(F.col("rank") <= 2 * max_nodes).select("x", "y"))
    seen = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    # at most max_nodes rows a seed from here on, and max_nodes times as many while a level is opened
    order = Window.partitionBy("seed").orderBy("node")
    for hop in range(1, depth + 1):
        step = frontier.hint("merge").join(near.hint("merge"), F.col("node") == F.col("x")).select("seed", F.col("y").alias("node")).distinct()
        new = step.hint("merge").join(seen.hint("merge"), ["seed", "node"], "left_anti")
        spent = seen.groupBy("seed").agg(F.count(F.lit(1)).alias("spent"))
        fits = new.withColumn("rn", F.row_number().over(order)).hint("merge").join(spent.hint("merge"), "seed").where(F.col("rn") + F.col("spent") <= max_nodes)
        frontier = cut(fits.select("seed", "node", F.lit(hop).alias("depth")))
        seen = cut(seen.unionByName(frontier))
    return seen


def neighborhood_edges(nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``(seed, node, source, target, ...)``: the edges of each node of a neighbourhood that lies before its border.

    An edge between two such nodes is returned twice, once for each that sees it; a self-loop once.
    """
    opened = nodes.where(F.col("depth") < depth).select("seed", "node")
    ends = F.when(F.col("source").eqNullSafe(F.col("target")), F.array("source")).otherwise(F.array("source", "target"))
    by_end = edges.withColumn("node", F.explode(ends)).where(F.col("node").isNotNull())
    return opened.hint("merge").join(by_end.hint("merge"), "node").select("seed", "node", *edges.columns)


def shortest_path(seeds: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """``(seed, node, weight, path)``: the lightest undirected path of at most ``max_hops`` edges to each node.

    Of parallel edges the lightest counts; each round extends last round's best paths, and
    equal weights go to the smaller path.
    """
    both = cut(undirected(edges).groupBy("x", "y").agg(F.min("weight").alias("w")))
    level = cut(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0.0).alias("weight"), F.col("id").cast("string").alias("path")))
    every = level
    for _ in range(max_hops):
        grown = level.join(both, F.col("node") == F.col("x")).select("seed", F.col("y").alias("node"), (F.col("weight") + F.col("w")).alias("weight"), F.concat_ws(">", "path", "y").alias("path"))
        best = grown.groupBy("seed", "node").agg(F.min(F.struct("weight", "path")).alias("m")).select("seed", "node", "m.weight", "m.path")
        known = every.select("seed", "node", F.col("weight").alias("known"))
        # a node goes on only where this round improved it
        level = cut(best.join(known, ["seed", "node"], "left").where(F.col("known").isNull() | (F.col("weight") < F.col("known") - 1e-12)).select("seed", "node", "weight", "path"))
        every = cut(every.unionByName(level).groupBy("seed", "node").agg(F.min(F.struct("weight", "path")).alias("m")).select("seed", "node", "m.weight", "m.path"))
    return every


def shared_connections(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``(a, b, node)``: nodes next to both of a pair, other than the pair itself."""
    both = store(undirected(edges).select("x", "y").distinct())
    # a pair asks for the neighbours of the end that has fewer, and looks them up at the other
    sizes = store(both.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    asked = store(pairs.where("a is not null and b is not null").distinct())
    for end in ("a", "b"):
        asked = asked.hint("merge").join(sizes.select(F.col("x").alias(end), F.col("n").alias(f"n_{end}")).hint("merge"), end)
    few, many = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a"))
    left = asked.withColumn("x", few).withColumn("other", many).hint("merge").join(both.hint("merge"), "x").select("a", "b", "other", F.col("y").alias("node"))
    met = left.hint("merge").join(both.select(F.col("x").alias("other"), F.col("y").alias("node")).hint("merge"), ["other", "node"])
    return met.where("node <> a and node <> b").select("a", "b", "node")


def motif_address(entities: DataFrame, least: int = 3) -> DataFrame:
    met = entities.where(F.coalesce("address", F.lit("")) != "").groupBy("address").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return met.select("address", "n", F.when(F.col("n") >= 5, "high").otherwise("medium").alias("severity"))


def motif_officer(entities: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Individuals with edges of employment, affiliation or ownership to several vendors."""
    who, firms = entities.where("entity_type = 'individual'").select(F.col("entity_id").alias("source")), entities.where("entity_type = 'vendor'").select(F.col("entity_id").alias("target"))
    own = edges.where(F.col("rel_type").isin("employs", "affiliated_with", "owns")).join(who, "source", "left_semi").join(firms, "target", "left_semi")
    met = own.groupBy("source").agg(F.countDistinct("target").alias("n")).where(F.col("n") >= least)
    return met.select("source", "n", F.when(F.col("n") >= 3, "high").otherwise("medium").alias("severity"))


def motif_hub(edges: DataFrame, least: int = 5) -> DataFrame:
    return edges.groupBy("source", "rel_type").agg(F.countDistinct("target").alias("n")).where(F.col("n") >= least)


def case_edges(cases: DataFrame, edges: DataFrame, entities: DataFrame, cap: int = 100) -> DataFrame:
    """Edges with both names where either name is the case's vendor, the first ``cap`` of each case.

    They are found once for each name that some case asks for, so that cases of one vendor share them.
    """
    name = entities.select("entity_id", "canonical_name").distinct()
    wanted = store(cases.where("vendor_name is not null").select("vendor_name").distinct())
    # entities that a case asks for meet the edges first; the name of the other end is looked up for those that are kept
    asked = store(name.hint("merge").join(wanted.select(F.col("vendor_name").alias("canonical_name")).hint("merge"), "canonical_name", "left_semi"))
    order = Window.partitionBy("vendor_name").orderBy("source", "target", "rel_type", "source_name", "target_name")

    def by(end: str, other: str) -> DataFrame:
        mine = asked.select(F.col("entity_id").alias(end), F.col("canonical_name").alias(f"{end}_name"))
        theirs = name.select(F.col("entity_id").alias(other), F.col("canonical_name").alias(f"{other}_name"))
        own = edges.select("source", "target", "rel_type").hint("merge").join(mine.select(end).distinct().hint("merge"), end, "left_semi")
        own = own.hint("merge").join(theirs.select(other).distinct().hint("merge"), other, "left_semi")
        # no case has more edges than cap, so no entity needs more of its own; equal edges share a rank
        first = own.withColumn("rn", F.dense_rank().over(Window.partitionBy(end).orderBy("source", "target", "rel_type"))).where(F.col("rn") <= cap).select("source", "target", "rel_type").distinct()
        met = first.hint("merge").join(mine.hint("merge"), end).hint("merge").join(theirs.hint("merge"), other)
        return met.select(F.col(f"{end}_name").alias("vendor_name"), "source", "target", "rel_type", "source_name", "target_name")

    met = by("source", "target").union(by("target", "source")).distinct()
    first = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).drop("rn")
    columns = ["case_id", "source", "target", "rel_type", "source_name", "target_name"]
    shared = cases.select("case_id", "vendor_name").distinct().hint("merge").join(store(first).hint("merge"), "vendor_name").select(columns)
    again = Window.partitionBy("case_id").orderBy("source", "target", "rel_type", "source_name", "target_name")
    # a case of several names has at most cap edges of each
    return shared.distinct().withColumn("rn", F.row_number().over(again)).where(F.col("rn") <= cap).drop("rn")


def weighted_degree(edges: DataFrame) -> DataFrame:
    return _ends(edges).groupBy("id").agg((1 + F.sum(F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0)))).alias("size"))


def claim_graph(claims: DataFrame, phrases) -> DataFrame:
    """``(a, b, n)``: pairs of phrases of one claim, and in how many claims they meet."""
    placed = store(claims.select("claim_id", F.posexplode(phrases).alias("i", "phrase")))
    pairs = placed.select("claim_id", "i", F.col("phrase").alias("a")).join(placed.select("claim_id", F.col("i").alias("j"), F.col("phrase").alias("b")), "claim_id").where("i < j")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def ownership_chain(parents: DataFrame) -> DataFrame:
    """``(child, root, depth)`` over ``(child, parent)``: the end of each chain and its length; null for both where it runs into a circle.

    Every round doubles the length of the chains that go on, so that their number of rounds is the logarithm of the longest.
    """
    parents = parents.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()
    chain = cut(parents.select("child", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    children = cut(chain.select(F.col("child").alias("root")).distinct())
    goes_on = lambda: chain.hint("merge").join(children.hint("merge"), "root", "left_semi")
    for _ in range(children.count().bit_length()):
        if goes_on().isEmpty():
            break
        further = chain.select(F.col("child").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = chain.hint("merge").join(further.hint("merge"), "root", "left")
        chain = cut(step.select("child", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).distinct())
    ends = chain.hint("merge").join(children.hint("merge"), "root", "left_anti").select("child", "root", "depth")
    return ends.union(goes_on().select("child", F.lit(None).alias("root"), F.lit(None).alias("depth")).distinct())


def common_owner(bids: DataFrame, owns: DataFrame, least: int = 2) -> DataFrame:
    """``(award_id, owner, n)``: owners of ``least`` or more of the firms that compete for one award.

    ``bids`` is (award_id, firm), ``owns`` (owner, firm). A bid meets the owners of its firm and is counted under
    award and owner, reduced before it is shuffled; firms of an award are never paired.
    """
    known = lambda df: df.where(" and ".join(f"{c} is not null" for c in df.columns)).distinct()
    met = known(bids.select("award_id", "firm")).hint("merge").join(known(owns.select("owner", "firm")).hint("merge"), "firm")
    return met.groupBy("award_id", "owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def owner_awards(parents: DataFrame, awards: DataFrame) -> DataFrame:
    """``(root, leaves, layers, awards, cents)``: what the last owners of each chain win through the leaves under them.

    ``parents`` is (child, parent), ``awards`` (vendor_id, cents). A leaf is a child that owns nobody; its awards are summed
    before they are carried up to its roots. Leaves without awards count; those that run into a circle are
    reported under the root null, each circle's leaves together.
    """
    chain = cut(ownership_chain(parents))
    owners = parents.where("child is not null and parent is not null").select(F.col("parent").alias("child")).distinct()
    leaves = chain.hint("merge").join(owners.hint("merge"), "child", "left_anti")
    sums = awards.where("vendor_id is not null").groupBy(F.col("vendor_id").alias("child")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    # a leaf that reaches a root by several ways wins its awards once
    carried = leaves.groupBy("child", "root").agg(F.max("depth").alias("depth")).hint("merge").join(sums.hint("merge"), "child", "left")
    zero = F.lit(0).cast("long")
    return carried.groupBy("root").agg(F.count(F.lit(1)).alias("leaves"), F.max("depth").alias("layers"), F.coalesce(F.sum("n"), zero).alias("awards"), F.coalesce(F.sum("cents"), zero).alias("cents"))
