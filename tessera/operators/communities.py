"""Communities by greedy modularity, and their reports."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import materialize
from .graph import connected_components


def greedy_modularity(links: dict[tuple[str, str], float], two_m: float) -> list[list[str]]:
    """Groups of nodes: the pair of groups whose union raises modularity most is joined while it does not lower it.

    ``links``: weight of each pair (ordered, loops allowed); ``two_m``: twice the weight of the whole graph.  Ties
    go to the smallest names.  Joining groups without a link always lowers modularity, so a connected
    component can be solved on its own, given ``two_m`` of the whole graph.

    A link is kept by one of its groups, at first that with more links.  The heap has one entry a group, the best of the links it keeps;
    as degrees grow, gains only fall, so an entry is a bound, and it is made anew when it comes up.  A union costs as many steps as
    the group with fewer links has, and one pass of numpy over those that the other keeps.
    """
    names = sorted({x for pair in links for x in pair})
    number = {x: i for i, x in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    weights = [0.0] * len(names)
    for (a, b), w in links.items():
        for x, y in ((number[a], number[b]), (number[b], number[a])):
            weights[x] += w
            if x != y:
                near[x][y] = near[x].get(y, 0.0) + w
    degree, label, up = np.array(weights), np.arange(len(names)), list(range(len(names)))
    rows = [_Row() for _ in names]
    for x, linked in enumerate(near):
        for y, w in linked.items():
            if (len(linked), x) > (len(near[y]), y):
                rows[x].put(y, w)
    joined = 0

    def entry(x: int, y: int, gain: float, at: int) -> tuple:
        return (-gain, *sorted((int(label[x]), int(label[y]))), x, y, at)

    def best(x: int) -> tuple | None:
        if not rows[x].place:
            return None
        y, w = rows[x].pairs()
        gain = w / two_m * 2 - 2 * degree[x] * degree[y] / two_m**2
        top = gain.max()
        ties = y[gain == top]
        return entry(x, int(ties[label[ties].argmin()]), float(top), joined)

    bound = [best(x) for x in range(len(names))]
    heap = [e for e in bound if e]
    heapq.heapify(heap)

    def offer(x: int, e: tuple | None) -> None:
        bound[x] = e
        if e:
            heapq.heappush(heap, e)

    def raised(x: int, y: int) -> None:
        e = entry(x, y, float(near[x][y] / two_m * 2 - 2 * degree[x] * degree[y] / two_m**2), -1)
        if bound[x] is None or e < bound[x]:
            offer(x, e)

    while heap:
        e = heapq.heappop(heap)
        if bound[e[3]] is not e:
            continue
        if e[0] > 0:
            break
        if e[5] != joined and (now := best(e[3])) != (*e[:5], joined):
            offer(e[3], now)
            continue
        x, y = sorted(e[3:5], key=lambda z: len(near[z]))
        up[x], joined = y, joined + 1
        degree[y] += degree[x]
        renamed = label[x] < label[y]
        label[y] = min(label[x], label[y])
        del near[x][y], near[y][x]
        rows[y].drop(x)
        changed = []
        for z, w in near[x].items():
            del near[z][x]
            rows[z].drop(x)
            near[y][z] = near[z][y] = w = near[y].get(z, 0.0) + w
            if y in rows[z].place or (z not in rows[y].place and len(near[z]) > len(near[y])):
                rows[z].put(y, w)
                changed.append(z)
            else:
                rows[y].put(z, w)
        near[x], rows[x], bound[x] = {}, _Row(), None
        for z in [z for z in near[y] if y in rows[z].place] if renamed else changed:
            raised(z, y)
        offer(y, best(y))
    groups: dict[int, list[str]] = {}
    for i, x in enumerate(names):
        while up[i] != up[up[i]]:
            up[i] = up[up[i]]
        groups.setdefault(up[i], []).append(x)
    return sorted(groups.values())


class _Row:
    """The links that a group keeps: the other groups and the weights, side by side."""

    __slots__ = ("place", "to", "w", "n")

    def __init__(self):
        self.place: dict[int, int] = {}
        self.to, self.w, self.n = np.empty(2, np.int64), np.empty(2), 0

    def put(self, y: int, w: float) -> None:
        if (at := self.place.get(y)) is None:
            if self.n == len(self.to):
                self.pairs()
                self.to, self.w = np.resize(self.to, 2 * self.n + 2), np.resize(self.w, 2 * self.n + 2)
            at = self.place[y] = self.n
            self.n += 1
        self.to[at], self.w[at] = y, w

    def drop(self, y: int) -> None:
        if (at := self.place.pop(y, None)) is not None:
            self.w[at] = -np.inf

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(group, weight) of the links; a few of links that are gone may be among them, of weight -inf."""
        if self.n > 2 * len(self.place) + 8:
            kept = np.flatnonzero(self.w[: self.n] > -np.inf)
            self.n = len(kept)
            self.to[: self.n], self.w[: self.n] = self.to[kept], self.w[kept]
            self.place = {y: i for i, y in enumerate(self.to[: self.n].tolist())}
        return self.to[: self.n], self.w[: self.n]


#: Links of a component beyond which its groups are joined in parallel rounds, before one task solves what is left.
LARGE = 200_000


def modularity(links: DataFrame, two_m: float) -> float:
    """Modularity of groups given by the weights between and (as loops) inside them (a, b, w)."""
    ends = links.select(F.explode(F.array("a", "b")).alias("x"), "w").groupBy("x").agg(F.sum("w").alias("k"))
    inside = links.where("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    return 2 * inside / two_m - (ends.agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0))).first()[0]) / two_m**2


def joined_groups(links: DataFrame, two_m: float, turn: int, pairs_only: bool) -> DataFrame:
    """(x, y): groups x that go into groups y, of groups linked by (a, b, w), whose union raises modularity.

    Every group names the neighbour with which it gains most, ties by name.  Two that name each other are a pair; pairs don't touch, so their
    gains add up.  Unless only these are asked for, a coin is tossed for each group and turn, and all that fell on one side go
    into the neighbour they name if its coin fell on the other: so the many leaves of a hub join it at once.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("x"), "w").groupBy("x").agg(F.sum("w").alias("k"))
    between = links.where("a <> b").join(degree.toDF("a", "_ka"), "a").join(degree.toDF("b", "_kb"), "b")
    gain = F.col("w") * (2 / two_m) - 2 * F.col("_ka") * F.col("_kb") / two_m**2
    good = between.withColumn("g", gain).where("g > 0").select(F.struct((-F.col("g")).alias("g"), "a", "b").alias("l"), F.explode(F.array("a", "b")).alias("x"))
    best = good.groupBy("x").agg(F.min("l").alias("l")).select("x", F.when(F.col("l.a") == F.col("x"), F.col("l.b")).otherwise(F.col("l.a")).alias("y"))
    best = materialize(best, "best")
    mutual = best.join(best.toDF("y", "x"), ["x", "y"]).where("x > y")
    if pairs_only:
        return mutual
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    return best.where((coin("x") == 0) & (coin("y") == 1))


def contracted(links: DataFrame, two_m: float, limit: int) -> tuple[DataFrame, DataFrame]:
    """(links of groups (component, a, b, w), (node, group)) of links (component, a, b, w), with no component of more than ``limit`` links that could still gain.

    A round joins groups all over the component at once; one that would lower modularity is made again with pairs only, which
    never do.  Groups are named by one of their nodes.
    """
    of = None
    turn = 0
    while True:
        many = links.where("a <> b").groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("component")
        large = materialize(links.join(many, "component", "left_semi"), "large")
        if large.isEmpty():
            break
        before = modularity(links, two_m)
        for pairs_only in (False, True):
            moves = materialize(joined_groups(large.select("a", "b", "w"), two_m, turn, pairs_only), "moves")
            if moves.isEmpty():
                continue
            to = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c))
            moved = links.join(moves.toDF("a", "_a"), "a", "left").join(moves.toDF("b", "_b"), "b", "left").select("component", F.least(to("a"), to("b")).alias("a"), F.greatest(to("a"), to("b")).alias("b"), "w")
            moved = materialize(moved.groupBy("component", "a", "b").agg(F.sum("w").alias("w")), "links")
            if pairs_only or modularity(moved, two_m) >= before:
                break
        else:
            break  # no union gains anything
        links, turn = moved, turn + 1
        if of is None:
            of = moves.toDF("node", "group")
        else:
            step = moves.toDF("group", "_to")
            carried = of.join(step, "group", "left").select("node", F.coalesce("_to", "group").alias("group"))
            of = carried.unionByName(moves.toDF("node", "group").join(of.select("node"), "node", "left_anti"))
        of = materialize(of, "groups")
    return links, of if of is not None else links.select(F.col("a").alias("node"), F.col("a").alias("group")).limit(0)


def community_labels(entities: DataFrame, edges: DataFrame, large: int | None = None) -> DataFrame:
    """(title, community): for each node the smallest name of its community; nodes without edges are communities of their own.

    Parallel and reverse edges count once, with the weight of the last.  A connected component is solved in one task (the greedy
    algorithm is sequential), components are spread over the cluster; one of more than ``large`` links is contracted in
    parallel rounds first (see ``contracted``), until one task can hold it or no union gains anything.
    """
    large = LARGE if large is None else large
    weight = F.greatest(F.lit(0.01), F.col("reliability"))
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), weight.alias("w"), "ord", "id")
    links = pair.groupBy("a", "b").agg(F.max_by("w", F.struct("ord", "id")).alias("w"))
    comp = connected_components(edges)
    inside = materialize(links.join(comp.select(F.col("node").alias("a"), "component"), "a"), "links")
    two_m = inside.agg(2 * F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] + 2 * links.join(inside.select("a"), "a", "left_anti").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    left, of = contracted(inside.select("component", "a", "b", "w"), two_m, large)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = greedy_modularity({(a, b): w for a, b, w in zip(pdf.a, pdf.b, pdf.w, strict=True)}, two_m)
        return pd.DataFrame([(x, g[0]) for g in groups for x in g], columns=["x", "y"])

    small = left.where("a <> b").groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") <= large)
    solved = left.join(small, "component", "left_semi").groupBy("component").applyInPandas(solve, "x string, y string")
    first = comp.select("node").join(of, "node", "left").select("node", F.coalesce("group", "node").alias("x"))
    named = first.join(solved, "x", "left").select("node", F.coalesce("y", "x").alias("g"))
    lowest = named.groupBy("g").agg(F.min("node").alias("community"))
    found = named.join(lowest, "g").select(F.col("node").alias("title"), "community")
    alone = entities.select("title").distinct().join(found, "title", "left_anti").select("title", F.col("title").alias("community"))
    return found.unionByName(alone)


def grouped(labels: DataFrame) -> DataFrame:
    """(community, id, members) of labels (title, community) or members (title, members)."""
    if "members" in labels.columns:
        labels = labels.select("title", F.col("members")[0].alias("community"))
    listed = labels.groupBy("community").agg(F.sort_array(F.collect_set("title")).alias("members"))
    return listed.select("community", t.stable_id("community", F.array_join("members", "\x1f")).alias("id"), "members")


def community_members(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(title, members): for each node the sorted names of its community."""
    labels = materialize(community_labels(entities, edges), "labels")
    return labels.join(grouped(labels), "community").select("title", "members")


def communities(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, entity_ids, edge_ids, level): the communities, given as labels or members, with the edges inside them."""
    named = grouped(members)
    inside = _inside(named, edges).groupBy("id").agg(F.sort_array(F.collect_set("edge_id")).alias("edge_ids"))
    out = named.select("id", F.col("members").alias("entity_ids")).join(inside, "id", "left")
    return out.select("id", "entity_ids", F.coalesce("edge_ids", F.array().cast("array<string>")).alias("edge_ids"), F.lit(0).alias("level"))


def _inside(named: DataFrame, edges: DataFrame) -> DataFrame:
    own = named.select(F.explode("members").alias("title"), "id")
    a = own.select(F.col("title").alias("source"), "id")
    b = own.select(F.col("title").alias("target"), F.col("id").alias("id2"))
    kept = edges.select(F.col("id").alias("edge_id"), "source", "target", "reliability", "weight", "semantic_summary", "description")
    return kept.join(a, "source").join(b, "target").where("id = id2")


def reports(members: DataFrame, edges: DataFrame, facts: int = 8) -> DataFrame:
    """(id, community_id, title, summary, entity_ids, edge_ids, reliability): the best facts of each community."""
    named = grouped(members)
    best = Window.partitionBy("id").orderBy(F.desc("reliability"), F.desc("weight"), "edge_id")
    ranked = _inside(named, edges).withColumn("n", F.row_number().over(best))
    text = F.coalesce(F.nullif("semantic_summary", F.lit("")), "description")
    top = F.when(F.col("n") <= facts, F.struct("n", text.alias("fact"), "edge_id"))
    told = ranked.groupBy("id").agg(F.sort_array(F.collect_list(top)).alias("top"), F.avg("reliability").alias("mean"))
    base = named.select("id", "members").join(told, "id", "left")
    return base.select(
        t.stable_id("report", F.col("id")).alias("id"), F.col("id").alias("community_id"), F.array_join(F.slice("members", 1, 4), ", ").alias("title"),
        F.when(F.col("top").isNotNull(), F.array_join("top.fact", " ")).otherwise(F.concat(F.lit("Entity: "), F.col("members")[0], F.lit("."))).alias("summary"),
        F.col("members").alias("entity_ids"), F.coalesce("top.edge_id", F.array().cast("array<string>")).alias("edge_ids"),
        F.round(F.coalesce("mean", F.lit(0.5)), 6).alias("reliability"),
    )
