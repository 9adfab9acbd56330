"""Communities: detection, ids, reports.

detect() raises modularity by moves and refinement in rounds (Traag, Waltman and van Eck, 2019), all of it joins and aggregations:
every node moves to the neighbouring community that gains most, until none does. Then, within each community, nodes start
again as singletons, and those that are well connected to the rest of it join neighbours; what comes together are the nodes of
the next level's smaller graph, which begins in the communities found. A part is joined along edges alone, so communities of
all levels are connected, and levels are nested. greedy() merges communities pairwise instead (Clauset, Newman and Moore, 2004), in
rounds of many merges. One method serves graphs of any size, and no graph, part or neighbourhood is gathered in one task.
Both run for each root by itself, on all roots at once.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identity import community_id, singleton_community_id
from tessera.session import cut, ship

#: Rounds of moves of a level, and levels. Moves that are left when rounds end are made in the next level's graph or not at all.
ROUNDS, LEVELS = 12, 8
#: Rounds of the last level go on, dealt anew, until no move is left, or so many times with those of the levels before.
DEALS = 24


class Reporter(Protocol):
    """Writes the prose of a community's report from its facts."""

    def report(self, names: list[str], files: list[str], edge_count: int) -> tuple[str, str, list[str]]: ...


def _by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled by its key: what grows with the graph would, while it is small enough to be broadcast, pass through the
    driver in every round."""
    return df.hint("merge")


def _moved(nodes: DataFrame, links: DataFrame, deal: int = 0) -> tuple[DataFrame, bool]:
    """(node, group, k, total) after rounds of moves, and whether no move was left.

    nodes: (node, group, k, total), k the sum of a node's weights, total that of its root; links: (a, b, w), each in both directions, no loops.
    In a round only the nodes of one half, dealt anew by a hash, may move, so neighbours rarely swap places for ever. Calls with other deals
    deal other halves: those that have swapped all along in one part in the next.
    """
    now = cut(nodes.select("node", "group", "k", "total"))
    quiet = 0
    for r in range(deal * ROUNDS, (deal + 1) * ROUNDS):
        size = now.groupBy("group").agg(F.sum("k").alias("size"))
        seen = links.join(_by_key(now.select(F.col("node").alias("b"), "group")), "b").select(F.col("a").alias("node"), "group", "w")
        seen = seen.union(now.select("node", "group", F.lit(0.0))).groupBy("node", "group").agg(F.sum("w").alias("w"))
        own = now.select("node", F.col("group").alias("own"), "k", "total")
        # What a node's links to a community are worth beyond what they would be by chance.
        rest = F.col("size") - F.when(F.col("group") == F.col("own"), F.col("k")).otherwise(0.0)
        worth = seen.join(_by_key(size), "group").join(_by_key(own), "node").withColumn("worth", F.round(F.col("w") - F.col("k") * rest / F.col("total"), 9))
        best = worth.groupBy("node", "own", "k", "total").agg(F.min(F.struct((-F.col("worth")).alias("minus"), "group")).alias("best"), F.max(F.when(F.col("group") == F.col("own"), F.col("worth"))).alias("stay"))
        may = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        goes = may & (-F.col("best.minus") > F.col("stay"))
        now = cut(best.select("node", F.when(goes, F.col("best.group")).otherwise(F.col("own")).alias("group"), "k", "total", goes.alias("moved")))
        n = now.where("moved").count()
        now, quiet = now.drop("moved"), 0 if n else quiet + 1
        if quiet == 2:  # neither half has a move left
            break
    return now, quiet == 2


def _refined(nodes: DataFrame, links: DataFrame, deal: int = 0) -> tuple[DataFrame, int]:
    """(node, part, group, k, total), parts of the groups of nodes (node, group, k, total), and how many nodes joined one.

    A node that is alone and well connected to its group (its links to the group are no fewer than chance gives) joins the part of the group with
    the largest gain above zero. In a round the alone of one half, by a hash, may join parts that do not move in it: nodes of the other half, and
    parts of several. Nobody leaves a part, so parts grow along links and stay connected."""
    own = nodes.select("node", "group", "k", "total")
    near = links.join(_by_key(own.select(F.col("node").alias("a"), F.col("group").alias("ga"))), "a").join(_by_key(own.select(F.col("node").alias("b"), F.col("group").alias("gb"))), "b").where("ga = gb").select("a", "b", "w")
    near = cut(near)
    size = own.groupBy("group").agg(F.sum("k").alias("size"))
    inside = near.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("inside"))
    well = own.join(_by_key(inside), "node").join(_by_key(size), "group").where(F.col("inside") >= F.col("k") * (F.col("size") - F.col("k")) / F.col("total") - 1e-9).select("node")
    well = cut(well)
    now = cut(own.withColumn("part", F.col("node")))
    joined, quiet = 0, 0
    for r in range(deal * ROUNDS, (deal + 1) * ROUNDS):
        parts = now.groupBy("part").agg(F.sum("k").alias("size"), F.count("*").alias("members"))
        half = F.pmod(F.xxhash64("node", F.lit(r // 2), F.lit(9)), F.lit(2)) == r % 2
        alone = now.join(_by_key(parts.where("members = 1").select("part")), "part", "left_semi").join(_by_key(well), "node", "left_semi").where(half).select("node", "k", "total")
        still = now.select(F.col("node").alias("b"), "part").join(_by_key(alone.select(F.col("node").alias("b"))), "b", "left_anti")
        seen = near.join(_by_key(alone.withColumn("a", F.col("node"))), "a").join(_by_key(still), "b").groupBy("node", "k", "total", "part").agg(F.sum("w").alias("w"))
        worth = seen.join(_by_key(parts), "part").withColumn("worth", F.round(F.col("w") - F.col("k") * F.col("size") / F.col("total"), 9)).where("worth > 0")
        best = worth.groupBy("node").agg(F.min(F.struct((-F.col("worth")).alias("minus"), "part")).alias("best")).select("node", F.col("best.part").alias("to"))
        best = cut(best)
        n = best.count()
        if n:
            now = cut(now.join(_by_key(best), "node", "left").withColumn("part", F.coalesce("to", "part")).drop("to"))
        joined, quiet = joined + n, 0 if n else quiet + 1
        if quiet == 2:
            break
    return now, joined


def _connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, part): the connected parts of the groups of nodes (node, group), by smallest names, pointers doubled in each round."""
    g = nodes.select("node", "group")
    near = links.join(_by_key(g.select(F.col("node").alias("a"), F.col("group").alias("ga"))), "a").join(_by_key(g.select(F.col("node").alias("b"), F.col("group").alias("gb"))), "b").where("ga = gb").select("a", "b")
    near, now = cut(near), cut(g.select("node", F.col("node").alias("part")))
    while True:
        least = near.join(_by_key(now.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("least"))
        step = now.join(_by_key(least), "node", "left").select("node", F.col("part").alias("old"), F.least("part", "least").alias("part"))
        far = now.select(F.col("node").alias("part"), F.col("part").alias("further"))
        step = cut(step.join(_by_key(far), "part").select("node", "old", F.least("part", "further").alias("part")))
        now = step.select("node", "part")
        if step.where("old <> part").isEmpty():
            return now


def _graph(entities: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, k, total), links (a, b, w)) of entities with pairs, links in both directions, each of weight 1."""
    both = cut(pairs.select(F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").withColumn("w", F.lit(1.0)))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    linked = cut(entities.select("root_id", F.col("entity_id").alias("node")).join(_by_key(degree), "node"))
    totals = linked.groupBy("root_id").agg(F.sum("k").alias("total"))
    return cut(linked.join(totals, "root_id").select("node", "k", "total")), both


def _contracted(links: DataFrame, to: DataFrame) -> DataFrame:
    """links between the parts (node, part) that their ends are in, without loops."""
    between = links.join(_by_key(to.select(F.col("node").alias("a"), F.col("part").alias("x"))), "a").join(_by_key(to.select(F.col("node").alias("b"), F.col("part").alias("y"))), "b")
    return cut(between.where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))


def detect(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root_id, entity_id, level, group). entities: (root_id, entity_id); pairs: (a, b), undirected, each once, without loops.

    Level 0 is the coarsest; a group of a level lies within one of the level before, and every group is connected. An entity without pairs is a group by
    itself, at level 0 alone, as are all where there are no pairs.
    """
    nodes, links = _graph(entities, pairs)
    nodes = nodes.withColumn("group", F.col("node"))
    every: list[DataFrame] = []
    member = nodes.select("node", F.col("node").alias("at"))
    left = nodes.count()
    deal = 0
    for _ in range(LEVELS):
        moved, settled = _moved(nodes, links, deal)
        parts, joined = _refined(moved, links, deal)
        deal += 1
        while not joined and not settled and deal < DEALS:
            moved, settled = _moved(moved, links, deal)
            parts, joined = _refined(moved, links, deal)
            deal += 1
        if not joined:
            # No part grows any more: what the last moves brought together, as far as it is connected, is the coarsest level.
            parts = moved.join(_by_key(_connected(moved, links)), "node")
            if parts.select("part").distinct().count() == left:
                break
        parts = cut(parts.select("node", "part", "group", "k", "total"))
        member = cut(member.join(_by_key(parts.select(F.col("node").alias("at"), "part")), "at").select("node", F.col("part").alias("at")))
        every.append(member)
        if not joined:
            break
        links = _contracted(links, parts)
        nodes = cut(parts.groupBy(F.col("part").alias("node")).agg(F.min("group").alias("group"), F.sum("k").alias("k"), F.max("total").alias("total")))
        left = nodes.count()
    alone = entities if not every else entities.join(_by_key(member.select(F.col("node").alias("entity_id"))), "entity_id", "left_anti")
    out = alone.select("root_id", "entity_id", F.lit(0).alias("level"), F.col("entity_id").alias("group"))
    for level, m in enumerate(reversed(every)):
        out = out.union(m.join(_by_key(entities.select("root_id", F.col("entity_id").alias("node"))), "node").select("root_id", F.col("node"), F.lit(level), "at"))
    return out


def greedy(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root_id, entity_id, level, group), of level 0: communities by greedy merging; arguments as for detect(), pairs unweighted.

    In a round every community names the one with which a merge gains most. Those that name each other merge, and a community that is named takes as
    many of those that name it, the largest gain first, as still gain with all before them taken; who takes is told by a hash, so that a chain
    does not collapse into one. Rounds end when no merge gains."""
    nodes, links = _graph(entities, pairs)
    now = cut(nodes.select("node", F.col("node").alias("part")))
    r = 0
    while True:
        size = nodes.select("node", "k", "total")
        gain = links.join(_by_key(size.select(F.col("node").alias("a"), "k", "total")), "a").join(_by_key(size.select(F.col("node").alias("b"), F.col("k").alias("kb"))), "b")
        gain = gain.withColumn("gain", F.round(F.col("w") - F.col("k") * F.col("kb") / F.col("total"), 9)).where("gain > 0")
        best = cut(gain.groupBy("a", "k", "total").agg(F.min(F.struct((-F.col("gain")).alias("minus"), "b", "kb", "w")).alias("x")).select("a", "k", "total", "x.*"))
        if best.isEmpty():
            break
        # A pair that names each other is led by its smaller name; of the others, a community takes or goes by a hash of the round.
        named = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        both = best.join(_by_key(named), "b", "left").withColumn("mutual", F.coalesce(F.col("back") == F.col("a"), F.lit(False)))
        goes = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(2)) == 0  # noqa: E731, B023
        leads = both.where("mutual").select(F.least("a", "b").alias("n")).distinct()
        bound = both.where("mutual and a > b").select(F.col("a").alias("n")).distinct()
        asks = both.where("not mutual or a > b").join(_by_key(bound.withColumnRenamed("n", "b")), "b", "left_anti").join(_by_key(leads.withColumnRenamed("n", "a")), "a", "left_anti")
        takes = F.col("mutual") | F.col("lead") | ~goes("b")
        asks = asks.join(_by_key(leads.select(F.col("n").alias("b"), F.lit(True).alias("is_lead"))), "b", "left").withColumn("lead", F.coalesce("is_lead", F.lit(False))).where(takes & (F.col("mutual") | goes("a")))
        w = Window.partitionBy("b").orderBy(F.desc("mutual"), "minus", "a").rowsBetween(Window.unboundedPreceding, -1)
        asks = asks.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0.0))).where(F.col("mutual") | (F.round(F.col("w") - F.col("k") * (F.col("kb") + F.col("before")) / F.col("total"), 9) > 0))
        to = cut(asks.select(F.col("a").alias("node"), F.col("b").alias("to")))
        parts = cut(nodes.join(_by_key(to), "node", "left").select("node", F.coalesce("to", "node").alias("part"), "k", "total"))
        now = cut(now.join(_by_key(parts.select(F.col("node").alias("part"), F.col("part").alias("to"))), "part").select("node", F.col("to").alias("part")))
        links = _contracted(links, parts)
        nodes = cut(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.max("total").alias("total")))
        r += 1
    every = entities.join(_by_key(now.select(F.col("node").alias("entity_id"), "part")), "entity_id", "left")
    return every.select("root_id", "entity_id", F.lit(0).alias("level"), F.coalesce("part", "entity_id").alias("group"))


def modularity(groups: DataFrame, pairs: DataFrame) -> float:
    """The modularity of one level of detect() over pairs."""
    n = pairs.count()
    g = groups.select("entity_id", "group")
    within = pairs.join(g.select(F.col("entity_id").alias("a"), F.col("group").alias("x")), "a").join(g.select(F.col("entity_id").alias("b"), F.col("group").alias("y")), "b").where("x = y").count()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("entity_id")).join(g, "entity_id").groupBy("group").agg(F.count("*").alias("d"))
    by_chance = ends.agg(F.sum(F.pow(F.col("d") / (2.0 * n), 2))).first()[0] or 0.0
    return within / n - by_chance if n else 0.0


def communities(groups: DataFrame) -> DataFrame:
    """(root_id, community_id, level, parent_id, entity_ids) from detect(), ids over the sorted members. The parent of a community is that of
    the level before in which its members lie."""
    c = groups.groupBy("root_id", "level", "group").agg(F.array_sort(F.collect_list("entity_id")).alias("entity_ids"))
    c = c.select("root_id", community_id("root_id", "entity_ids").alias("community_id"), "level", "group", "entity_ids")
    above = groups.join(_by_key(c.select("level", "group", F.col("community_id").alias("parent_id"))), ["level", "group"]).select("entity_id", (F.col("level") + 1).alias("level"), "parent_id")
    one = c.select("root_id", "community_id", "level", "entity_ids", F.col("entity_ids")[0].alias("entity_id")).join(_by_key(above), ["entity_id", "level"], "left")
    return one.select("root_id", "community_id", "level", "parent_id", "entity_ids")


def singletons(entities: DataFrame) -> DataFrame:
    """One community for each entity: what a graph without edges has."""
    return entities.select("root_id", singleton_community_id("root_id", "entity_id").alias("community_id"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.array("entity_id").alias("entity_ids"))


def extractive_reports(facts: DataFrame, least: int = 2) -> DataFrame:
    """(community_id, title, summary, findings, ...) from community_facts(), without a model; smaller communities have none."""
    n = F.size("names")
    title = F.substring(F.concat(F.array_join(F.slice("names", 1, 3), ", "), F.when(n > 3, F.concat(F.lit(" and "), (n - 3).cast("string"), F.lit(" more"))).otherwise("")), 1, 200)
    summary = F.substring(F.concat(n.cast("string"), F.lit(" entities in "), F.size("files").cast("string"), F.lit(" files, "), F.col("edge_count").cast("string"), F.lit(" relations")), 1, 500)
    findings = F.transform(F.slice("files", 1, 5), lambda f: F.substring(F.concat(F.lit("Defined in "), f), 1, 200))
    return facts.where(n >= least).select("community_id", title.alias("title"), summary.alias("summary"), findings.alias("findings"), F.col("names").alias("entity_names"), F.col("files").alias("file_paths"), "edge_count", F.lit("extractive").alias("generated_by"))


def reports(facts: DataFrame, reporter: Reporter, least: int = 2) -> DataFrame:
    """Reports by an injected model, called in the tasks; lengths are capped as for the extractive ones."""

    def write(batches):
        for x in batches:
            out = [reporter.report(list(a), list(b), int(c)) for a, b, c in zip(x.names, x.files, x.edge_count)]
            yield pd.DataFrame({"community_id": x.community_id, "title": [o[0][:200] for o in out], "summary": [o[1][:500] for o in out], "findings": [[f[:200] for f in o[2][:5]] for o in out]})

    ship(facts.sparkSession)
    return facts.where(F.size("names") >= least).mapInPandas(write, "community_id string, title string, summary string, findings array<string>")
