"""A directed road graph as tables: permission, snapping, shortest paths, bounds, checks.

Edges have (edge_id, start_node, end_node, length, speed, use, class, access, shortcut,
destination) and costs are whole milliseconds, so that sums are exact.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.geo import DEGREE_METRES, distance, turn_between
from plumbline.operators.lineage import Tables, cut, released
from plumbline.operators.snapping import COARSE, candidates

# The least dimension limits that let a car pass, by rule type.
LIMITS = {1: 190, 2: 200, 3: 500, 4: 180, 5: 110}
CLOSED_USES = (3, 7)
LAST_USE, TOP_SPEED = 11, 140
#: Edges, or points, of a tile that one group holds.
PART_ROWS = 250_000


def cost(length: Column, speed: Column) -> Column:
    """Milliseconds for so many metres at so many km/h."""
    return F.round(length * 3600 / speed).cast("long")


def allowed(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges open to cars: by their own attributes, and without a blocking rule (edge_id, type, value, modes)."""
    own = ~F.col("shortcut") & ~F.col("destination") & (F.col("access").bitwiseAND(1) == 1) & F.col("speed").between(1, TOP_SPEED) & (F.col("length") > 0)
    own &= (F.col("use") <= LAST_USE) & ~F.col("use").isin(*CLOSED_USES)
    limit = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    blocks = F.when(F.col("type").isin(*LIMITS), F.col("value") < F.try_element_at(limit, F.col("type"))).otherwise(F.col("modes").bitwiseAND(1) == 1)
    return edges.where(own).join(rules.where(blocks).select("edge_id"), "edge_id", "left_anti")


def opposing(edges: DataFrame) -> DataFrame:
    """(edge_id, opposite): the first edge that leads back."""
    back = edges.select(F.col("start_node").alias("end_node"), F.col("end_node").alias("start_node"), F.col("edge_id").alias("other"))
    return edges.join(back, ["start_node", "end_node"]).groupBy("edge_id").agg(F.min("other").alias("opposite"))


def incoming(edges: DataFrame) -> DataFrame:
    """(node, edges_in, cheapest): what ends at each node."""
    return edges.groupBy(F.col("end_node").alias("node")).agg(F.count("*").alias("edges_in"), F.min("cost").alias("cheapest"))


def shortest(edges: DataFrame, sources: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(source, node, cost) of the cheapest ways from each source (source) over (start_node, end_node, cost).

    Each round relaxes only the nodes that got cheaper in the last one, over arcs that are made
    once, and its result is a table of its own, which takes the place of the last one's.
    """
    tables = Tables(edges.sparkSession)
    arcs = tables.write(edges.groupBy("start_node", "end_node").agg(F.min("cost").alias("step")))
    best = tables.write(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("old")).distinct())
    for _ in range(max_rounds):
        frontier = best.where(F.col("old").isNull() | (F.col("cost") < F.col("old")))
        if frontier.isEmpty():
            return best.select("source", "node", "cost")
        reached = frontier.join(arcs, frontier["node"] == arcs["start_node"]).select("source", F.col("end_node").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(None).cast("long").alias("old"))
        last, best = best, tables.write(best.withColumn("old", F.col("cost")).unionAll(reached).groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old")))
        tables.drop(last)
    raise ValueError(f"no end after {max_rounds} rounds")


def landmark_costs(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(landmark, node, ahead, back): the cheapest ways from each landmark and to it; null where there is none."""
    there = shortest(edges, landmarks).select(F.col("source").alias("landmark"), "node", F.col("cost").alias("ahead"))
    turned = edges.select(F.col("end_node").alias("start_node"), F.col("start_node").alias("end_node"), "cost")
    home = shortest(turned, landmarks).select(F.col("source").alias("landmark"), "node", F.col("cost").alias("back"))
    return there.join(home, ["landmark", "node"], "full_outer")


def landmark_bounds(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """(origin, target, bound): a lower bound of the way between, from the triangle over each landmark."""
    of = lambda end: costs.select("landmark", F.col("node").alias(end), F.col("ahead").alias(f"{end}_ahead"), F.col("back").alias(f"{end}_back"))
    both = pairs.join(of("origin"), "origin").join(of("target"), ["landmark", "target"])
    one = F.greatest(F.lit(0), F.col("target_ahead") - F.col("origin_ahead"), F.col("origin_back") - F.col("target_back"))
    return both.groupBy("origin", "target").agg(F.max(one).cast("long").alias("bound"))


def directed(edges: DataFrame, pairs: DataFrame, costs: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(source, target, cost) of the cheapest way of each pair (source, target), by a search that landmarks bound.

    ``costs`` is what ``landmark_costs`` gives. Each round relaxes the nodes that got cheaper in
    the last one, but those whose cost and lower bound to the target come to more than the best
    way known, and those from which a landmark shows that the target cannot be reached.
    """
    tables = Tables(edges.sparkSession)
    arcs = tables.write(edges.groupBy("start_node", "end_node").agg(F.min("cost").alias("step")))
    targets = pairs.select("target").distinct()
    ends = targets.join(costs, targets["target"] == costs["node"]).select("landmark", "target", F.col("ahead").alias("t_ahead"), F.col("back").alias("t_back"))
    one = F.greatest(F.lit(0), F.col("t_ahead") - F.col("ahead"), F.col("back") - F.col("t_back"))
    # Whatever a landmark reaches from the node's side only, or reaches it from the target's only, has no way to the target.
    never = F.max((F.col("ahead").isNotNull() & F.col("t_ahead").isNull()) | (F.col("back").isNull() & F.col("t_back").isNotNull()))
    bounds = tables.write(costs.join(ends, "landmark").groupBy("node", "target").agg(F.max(one).cast("long").alias("bound"), never.alias("never")))
    best = tables.write(pairs.select("source", "target", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(None).cast("long").alias("old")).distinct())
    for _ in range(max_rounds):
        known = best.where(F.col("node") == F.col("target")).select("source", "target", F.col("cost").alias("held"))
        frontier = best.where(F.col("old").isNull() | (F.col("cost") < F.col("old")))
        if frontier.isEmpty():
            return known.select("source", "target", F.col("held").alias("cost"))
        reached = frontier.join(arcs, frontier["node"] == arcs["start_node"]).groupBy("source", "target", F.col("end_node").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("cost"))
        may = reached.join(bounds, ["node", "target"], "left").join(known, ["source", "target"], "left")
        may = may.where(~F.coalesce("never", F.lit(False)) & (F.col("held").isNull() | (F.col("cost") + F.coalesce("bound", F.lit(0)) <= F.col("held"))))
        may = may.select("source", "target", "node", "cost", F.lit(None).cast("long").alias("old"))
        last, best = best, tables.write(best.withColumn("old", F.col("cost")).unionAll(may).groupBy("source", "target", "node").agg(F.min("cost").alias("cost"), F.min("old").alias("old")))
        tables.drop(last)
    raise ValueError(f"no end after {max_rounds} rounds")


def transitions(edges: DataFrame, banned: DataFrame) -> DataFrame:
    """(edge_id, next_edge, step): pairs of edges that may follow each other. No way straight back, and no banned (edge_id, next_edge)."""
    a = edges.select("edge_id", F.col("start_node").alias("from_node"), F.col("end_node").alias("via"))
    b = edges.select(F.col("edge_id").alias("next_edge"), F.col("start_node").alias("via"), F.col("end_node").alias("to_node"), F.col("cost").alias("step"))
    pairs = a.join(b, "via").where(F.col("from_node") != F.col("to_node"))
    return pairs.join(banned, ["edge_id", "next_edge"], "left_anti").select("edge_id", "next_edge", "step")


def restricted(edges: DataFrame, banned: DataFrame, origin: DataFrame) -> DataFrame:
    """(source, node, cost): cheapest ways under turn restrictions, over the graph whose nodes are edges."""
    steps = transitions(edges, banned).select(F.col("edge_id").alias("start_node"), F.col("next_edge").alias("end_node"), F.col("step").alias("cost"))
    starts = origin.join(edges, origin["source"] == edges["start_node"]).select("source", F.col("edge_id").alias("first"), "cost")
    # One more arc into each edge that leaves the origin, from a start of its own; ids of edges are not negative.
    enter = starts.select((-F.col("source") - 1).alias("start_node"), F.col("first").alias("end_node"), "cost")
    ways = shortest(steps.unionAll(enter), origin.select((-F.col("source") - 1).alias("source")))
    ends = edges.select(F.col("edge_id").alias("e"), F.col("end_node").alias("at"))
    found = ways.join(ends, ways["node"] == ends["e"]).groupBy("source", "at").agg(F.min("cost").alias("cost"))
    return found.select((-F.col("source") - 1).alias("source"), F.col("at").alias("node"), "cost")


def departures(edges: DataFrame, links: DataFrame, widest: int = 3) -> DataFrame:
    """(node, edge_id): the edges that leave each node or a node of its junction, whose levels ``links`` (a, b) tie together at no cost.

    A junction of more than ``widest`` nodes is an error of the graph.
    """
    members = cut(groups(links))
    wide = members.groupBy("canonical").count().where(F.col("count") > widest).first()
    if wide:
        raise ValueError(f"junction {wide['canonical']} has {wide['count']} nodes, more than {widest}")
    other = members.select(F.col("node").alias("start_node"), "canonical")
    shared = members.join(other, "canonical").join(edges, "start_node").select("node", "edge_id")
    alone = edges.join(members.select(F.col("node").alias("start_node")), "start_node", "left_anti")
    return alone.select(F.col("start_node").alias("node"), "edge_id").unionAll(shared)


def turn_states(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What banned sequences (edges) of edge ids do to a way: (own, own_state, own_banned) and (state, own, next_state, next_banned).

    A state is the longest end of the way that begins a rule, as an array; the first table is
    for ways of which no end does, the second for the others, where an edge goes on with one of
    their ends. An edge in neither table leads to the empty state. Sizes follow the rules alone.
    """
    begun = rules.where(F.size("edges") > 0).select("edges", F.explode(F.sequence(F.lit(1), F.size("edges"))).alias("n"))
    prefixes = cut(begun.groupBy(F.slice("edges", F.lit(1), F.col("n")).alias("state")).agg(F.max(F.col("n") == F.size("edges")).alias("whole")))
    ends = prefixes.select("state", F.explode(F.transform(F.sequence(F.lit(1), F.size("state")), lambda k: F.slice("state", -k, k))).alias("end"))
    ends = cut(ends.join(prefixes.select(F.col("state").alias("end"), "whole"), "end"))
    banned = ends.groupBy(F.col("state").alias("next_state")).agg(F.max("whole").alias("next_banned"))
    child = prefixes.select(F.slice("state", F.lit(1), F.size("state") - 1).alias("end"), F.element_at("state", -1).alias("own"), F.col("state").alias("next_state")).join(banned, "next_state")
    first = child.where(F.size("end") == 0).select("own", F.col("next_state").alias("own_state"), F.col("next_banned").alias("own_banned"))
    longest = ends.select("state", "end").join(child, "end").groupBy("state", "own").agg(F.max_by(F.struct("next_state", "next_banned"), F.size("end")).alias("to"))
    return first, longest.select("state", "own", "to.next_state", "to.next_banned")


def sequence_restricted(edges: DataFrame, rules: DataFrame, sources: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(source, node, cost): cheapest ways from each source (source) that hold no banned sequence (edges) and never go straight back.

    A label is a node, a state of the rules and the node the way came from. Edges that no rule
    names count by the cheapest between two nodes. Of the labels of a node and a state the best
    two are kept, which come from different nodes: what goes straight back for one does not for
    the other. So labels grow with nodes and rules, not with pairs of edges.
    """
    first, later = turn_states(rules)
    named = rules.select(F.explode("edges").alias("edge_id")).distinct().withColumn("own", F.col("edge_id"))
    arcs = edges.select("edge_id", "start_node", "end_node", "cost").join(named, "edge_id", "left").groupBy("start_node", "end_node", "own").agg(F.min("cost").alias("step"))
    arcs = cut(arcs.join(first, "own", "left").where(~F.coalesce("own_banned", F.lit(False))).drop("own_banned"))
    later = cut(later)
    none = F.array().cast("array<bigint>")
    label = ["source", "node", "state", "came"]
    best = cut(sources.select("source", F.col("source").alias("node"), none.alias("state"), F.lit(None).cast("bigint").alias("came"), F.lit(0).cast("bigint").alias("cost"), F.lit(None).cast("bigint").alias("old")))
    order = Window.partitionBy("source", "node", "state").orderBy("cost", "came")
    for _ in range(max_rounds):
        frontier = best.where(F.col("old").isNull() | (F.col("cost") < F.col("old")))
        if frontier.isEmpty():
            return best.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        on = frontier.join(arcs, frontier["node"] == arcs["start_node"]).where(F.col("came").isNull() | (F.col("came") != F.col("end_node")))
        on = on.join(later, ["state", "own"], "left").where(~F.coalesce("next_banned", F.lit(False)))
        reached = on.select("source", F.col("end_node").alias("node"), F.coalesce("next_state", "own_state", none).alias("state"), F.col("start_node").alias("came"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(None).cast("bigint").alias("old"))
        held = best.withColumn("old", F.col("cost")).unionByName(reached).groupBy(*label).agg(F.min("cost").alias("cost"), F.min("old").alias("old"))
        best = cut(held.withColumn("nth", F.row_number().over(order)).where("nth <= 2").drop("nth"))
    raise ValueError(f"no end after {max_rounds} rounds")


def joined_shapes(steps: DataFrame, shapes: DataFrame, widest: float = 0.5) -> DataFrame:
    """(source, target, points, metres, gap, joined): the shapes (edge_id, shape) of the edges of each way, end to end.

    ``steps`` is what ``paths`` gives, step 0 being the last edge. ``gap`` is the widest distance
    between the end of a shape and the start of the next; up to ``widest`` metres count as joined,
    and the first point of the next is then left out.
    """
    w = Window.partitionBy("source", "target").orderBy(F.desc("step"))
    head, tail = F.element_at("shape", 1), F.element_at("shape", -1)
    rows = steps.join(shapes, "edge_id").withColumn("came", F.lag(tail).over(w))
    gap = F.when(F.col("came").isNull(), 0.0).otherwise(distance(F.col("came.lat"), F.col("came.lng"), head["lat"], head["lng"]))
    between = lambda a, b: distance(a["lat"], a["lng"], b["lat"], b["lng"])
    pairs = F.zip_with(F.slice("shape", F.lit(1), F.size("shape") - 1), F.slice("shape", F.lit(2), F.size("shape") - 1), between)
    rows = rows.withColumns({"gap": gap, "metres": F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x)})
    rest = F.when(F.col("came").isNotNull() & (F.col("gap") <= widest), F.slice("shape", F.lit(2), F.size("shape") - 1)).otherwise(F.col("shape"))
    found = rows.withColumn("rest", rest).groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("at"), "rest"))).alias("parts"), F.sum("metres").alias("metres"), F.max("gap").alias("gap"))
    return found.select("source", "target", F.flatten(F.transform("parts", lambda x: x["rest"])).alias("points"), "metres", "gap", (F.col("gap") <= widest).alias("joined"))


def predecessors(edges: DataFrame, best: DataFrame) -> DataFrame:
    """(source, node, edge_id, before): the edge of smallest id by which the cheapest way reaches each node."""
    here = best.select("source", F.col("node").alias("end_node"), F.col("cost").alias("total"))
    there = best.select("source", F.col("node").alias("start_node"), F.col("cost").alias("so_far"))
    tight = here.join(edges, "end_node").join(there, ["source", "start_node"]).where((F.col("so_far") + F.col("cost") == F.col("total")) & (F.col("cost") > 0))
    return tight.groupBy("source", F.col("end_node").alias("node")).agg(F.min(F.struct("edge_id", "start_node")).alias("e")).select("source", "node", "e.edge_id", F.col("e.start_node").alias("before"))


def paths(edges: DataFrame, best: DataFrame, targets: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target, step, edge_id): the way to each target (source, target), step 0 being its last edge."""
    back = cut(predecessors(edges, best))
    here = targets.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("step"))
    out = None
    for _ in range(max_rounds):
        found = cut(here.join(back, ["source", "node"]).select("source", "target", "step", "edge_id", "before"))
        if found.isEmpty():
            return out if out is not None else edges.sparkSession.createDataFrame([], "source long, target long, step int, edge_id long")
        steps = found.select("source", "target", "step", "edge_id")
        out = steps if out is None else out.unionAll(steps)
        here = found.where(F.col("before") != F.col("source")).select("source", "target", F.col("before").alias("node"), (F.col("step") + 1).alias("step"))
    raise ValueError(f"ways are longer than {max_rounds} edges")


def within(arcs: DataFrame, labels: DataFrame, tables: Tables, max_rounds: int) -> DataFrame:
    """``labels`` (back, root, radius, node, best, old) and all that arcs (back, at, to, step, edge_id) reach from them within their radius.

    ``best`` is (cost, edge_id, came): the cost, and the edge of smallest id by which the cheapest way comes, from which node.
    """
    cheaper = F.col("old").isNull() | (F.col("best.cost") < F.col("old"))
    for _ in range(max_rounds):
        on = labels.where(cheaper).withColumnRenamed("back", "b").join(arcs, (F.col("b") == F.col("back")) & (F.col("node") == F.col("at")))
        on = on.where(F.col("best.cost") + F.col("step") <= F.col("radius"))
        best = F.struct((F.col("best.cost") + F.col("step")).alias("cost"), "edge_id", F.col("at").alias("came"))
        reached = on.select("back", "root", "radius", F.col("to").alias("node"), best.alias("best"), F.lit(None).cast("long").alias("old"))
        held = labels.withColumn("old", F.col("best.cost")).unionByName(reached)
        held, left = held.groupBy("back", "root", "node").agg(F.max("radius").alias("radius"), F.min("best").alias("best"), F.min("old").alias("old")), Observation()
        last, labels = labels, tables.write(held.observe(left, F.count_if(cheaper).alias("n")))
        tables.drop(last)
        if not left.get["n"]:
            return labels
    raise ValueError(f"no end after {max_rounds} rounds")


def met(arcs: DataFrame, labels: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, target, held): the cheapest way of each pair (source, target, ahead, behind) over one arc or none between its two searches."""
    caps = asked.groupBy("source").agg((F.max("ahead") + F.max("behind")).alias("cap"))
    own = labels.where(~F.col("back")).select(F.col("root").alias("source"), "node", F.col("best.cost").alias("cost"))
    out = own.join(caps, "source").join(arcs.where(~F.col("back")), F.col("node") == F.col("at")).where(F.col("cost") + F.col("step") <= F.col("cap"))
    there = own.unionAll(out.select("source", F.col("to").alias("node"), (F.col("cost") + F.col("step")).alias("cost"))).groupBy("source", "node").agg(F.min("cost").alias("cost"))
    home = labels.where("back").select(F.col("root").alias("target"), "node", F.col("best.cost").alias("rest"))
    return asked.select("source", "target").join(home, "target").join(there, ["source", "node"]).groupBy("source", "target").agg(F.min(F.col("cost") + F.col("rest")).alias("held"))


def ways_between(edges: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target, step, edge_id): the cheapest way of each pair (source, target), step 0 being its last edge, as ``paths`` over ``shortest`` has it.

    Searches go from the sources and, against the edges, from the targets, each up to a radius. A
    way no longer than the two radii of its pair has one arc or none between both searches, so the
    best that is found there is the cheapest. Else they go on, half as far again or to half of
    the best way known, or twice as far if none is, until a way is found or one of both has no edge left. So labels are
    those of two balls of about half the way for a pair, not all nodes for a source.
    """
    spark = edges.sparkSession
    tables = Tables(spark)
    one = edges.where(F.col("start_node") != F.col("end_node")).groupBy("start_node", "end_node").agg(F.min(F.struct("cost", "edge_id")).alias("e"))
    one = tables.write(one.select("start_node", "end_node", F.col("e.cost").alias("step"), "e.edge_id"))
    # Where edges cost nothing, ways of as few edges as can be, so that none goes in a circle.
    unit = 1
    if not one.where("step <= 0").isEmpty():
        unit, one = 1 << 20, one.withColumn("step", F.col("step") * (1 << 20) + 1)
    turn = lambda back, a, b: one.select(F.lit(back).alias("back"), F.col(a).alias("at"), F.col(b).alias("to"), "step", "edge_id")
    arcs = tables.write(turn(False, "start_node", "end_node").unionAll(turn(True, "end_node", "start_node")))
    far = tables.write(arcs.groupBy("back", "at").agg(F.max("step").alias("far"), F.min("step").alias("near")))
    first = int(4 * (far.agg(F.avg(F.greatest("near", F.lit(unit)))).first()[0] or 1))
    wanted = tables.write(pairs.select("source", "target").distinct().withColumn("want", F.lit(first).cast("long")))
    none, labels, done, found = F.lit(None).cast("long"), None, [], []
    for _ in range(max_rounds):
        radii = lambda end, name: wanted.groupBy(end).agg(F.max("want").alias(name))
        asked = tables.write(wanted.join(radii("source", "ahead"), "source").join(radii("target", "behind"), "target"))
        if asked.isEmpty():
            break
        root = lambda back, end, name: asked.select(F.lit(back).alias("back"), F.col(end).alias("root"), F.col(name).alias("radius")).distinct()
        roots = root(False, "source", "ahead").unionAll(root(True, "target", "behind"))
        if labels is None:
            labels = tables.write(roots.select("*", F.col("root").alias("node"), F.struct(F.lit(0).cast("long").alias("cost"), none.alias("edge_id"), none.alias("came")).alias("best"), none.alias("old")))
        else:
            done.append(tables.write(labels.join(roots, ["back", "root"], "left_anti")))
            last, labels = labels, tables.write(labels.drop("radius", "old").join(roots, ["back", "root"]).withColumn("old", none))
            tables.drop(last)
        labels = within(arcs, labels, tables, max_rounds)
        ends = labels.join(far.withColumnRenamed("at", "node"), ["back", "node"], "left").groupBy("back", "root").agg((F.max(F.col("best.cost") + F.coalesce("far", F.lit(0))) <= F.max("radius")).alias("whole"))
        whole = lambda back, end: ends.where(F.col("back") == back).select(F.col("root").alias(end), F.col("whole").alias(f"{end}_whole"))
        now = asked.join(met(arcs, labels, asked), ["source", "target"], "left").join(whole(False, "source"), "source").join(whole(True, "target"), "target")
        settled = F.col("source_whole") | F.col("target_whole") | F.coalesce(F.col("held") <= F.col("ahead") + F.col("behind"), F.lit(False))
        now = tables.write(now.withColumn("settled", settled))
        found.append(now.where("settled and held is not null").select("source", "target", "held", "ahead"))
        grown = F.when(F.col("held").isNull(), F.col("want") * 2).otherwise(F.least(F.ceil(F.col("held") / 2).cast("long"), F.col("want") + F.ceil(F.col("want") / 2).cast("long")))
        tables.drop(wanted, asked)
        wanted = tables.write(now.where("not settled").select("source", "target", grown.alias("want")))
    else:
        raise ValueError(f"no end after {max_rounds} rounds")
    if not found:
        return spark.createDataFrame([], "source long, target long, step int, edge_id long")
    every = lambda some: reduce(DataFrame.unionByName, some)
    held = every(done + [labels])
    ahead = held.where(~F.col("back")).select(F.col("root").alias("source"), "node", "best.*")
    behind = held.where("back").select(F.col("root").alias("target"), "node", F.col("best.cost").alias("rest"))
    # The arcs that leave the search ahead, then all by which cheapest ways go on from there to the target.
    out = every(found).where("held > ahead").join(ahead.select("source", "node", "cost"), "source").where("cost <= ahead")
    out = out.select("source", "target", "node", (F.col("held") - F.col("cost")).alias("left"), (F.col("ahead") - F.col("cost")).alias("least"))
    ways, arcs = [], arcs.where(~F.col("back")).drop("back")
    for _ in range(max_rounds):
        on = out.join(arcs, F.col("node") == F.col("at")).where((F.col("step") > F.col("least")) & (F.col("step") <= F.col("left")))
        on = on.select("source", "target", F.col("to").alias("node"), "edge_id", F.col("at").alias("came"), (F.col("left") - F.col("step")).alias("rest"))
        ways.append(tables.write(on.join(behind, ["target", "node", "rest"])))
        out = ways[-1].where("node <> target").select("source", "target", "node", F.col("rest").alias("left"), F.lit(0).alias("least")).distinct()
        if out.isEmpty():
            break
    else:
        raise ValueError(f"ways are longer than {max_rounds} edges")
    before = every(ways).groupBy("source", "target", "node").agg(F.min(F.struct("edge_id", "came")).alias("b"))
    before = tables.write(before)
    here = every(found).select("source", "target", F.col("target").alias("node"), F.lit(0).alias("step"))
    tree, steps = ahead.select("source", "node", F.struct("edge_id", "came").alias("a")), []
    for _ in range(max_rounds):
        on = here.join(before, ["source", "target", "node"], "left").join(tree, ["source", "node"], "left").withColumn("e", F.coalesce("b", "a"))
        steps.append(tables.write(on.where("e.edge_id is not null").select("source", "target", "step", "e.edge_id", "e.came")))
        if steps[-1].isEmpty():
            break
        here = steps[-1].where("came <> source").select("source", "target", F.col("came").alias("node"), (F.col("step") + 1).alias("step"))
    else:
        raise ValueError(f"ways are longer than {max_rounds} edges")
    return every(steps).select("source", "target", "step", "edge_id")


def verified_paths(steps: DataFrame, edges: DataFrame, best: DataFrame) -> DataFrame:
    """(source, target, edges, cost, continuous, cheapest): each way is checked from its edges alone, without the search."""
    w = Window.partitionBy("source", "target").orderBy(F.desc("step"))
    rows = steps.join(edges.select("edge_id", "start_node", "end_node", "cost"), "edge_id").withColumn("came", F.lag("end_node").over(w))
    ok = F.coalesce(F.col("came"), F.col("source")) == F.col("start_node")
    found = rows.groupBy("source", "target").agg(F.count("*").alias("edges"), F.sum("cost").alias("cost"), F.every(ok).alias("linked"), F.min(F.struct("step", "end_node")).alias("last"))
    wanted = best.select("source", F.col("node").alias("target"), F.col("cost").alias("best"))
    return found.join(wanted, ["source", "target"]).select("source", "target", "edges", "cost", (F.col("linked") & (F.col("last.end_node") == F.col("target"))).alias("continuous"), (F.col("cost") == F.col("best")).alias("cheapest"))


def snapped(points: DataFrame, edges: DataFrame, nodes: DataFrame, metres: float = 100.0) -> DataFrame:
    """(query_id, edge_id, metres): the nearest edge of (query_id, lat, lng) within reach, ties by id.

    Tiles are some dozens of reaches wide. Edges go into every tile that they cross, points into
    those that their circle meets; both wrap at the antimeridian, over which edges go the short
    way. Tiles with many rows are cut into parts of both. Points of the same place are one. The
    distance is that to the segment in the plane at the point. Which edges a point may snap to
    is the caller's choice (``staging.snap_eligible``).
    """
    at = lambda end: nodes.select(F.col("node_id").alias(f"{end}_node"), F.col("lat").alias(f"{end}_lat"), F.col("lng").alias(f"{end}_lng"))
    tables = Tables(edges.sparkSession)
    # Edges of the same ends are one segment, of which the smallest id counts.
    own = edges.groupBy("start_node", "end_node").agg(F.min("edge_id").alias("edge_id")).join(at("start"), "start_node").join(at("end"), "end_node")
    own = own.select("edge_id", F.col("start_lat").alias("y1"), F.col("start_lng").alias("x1"), F.col("end_lat").alias("y2"), (F.col("start_lng") + turn_between(F.col("start_lng"), F.col("end_lng"))).alias("x2"))
    own = tables.write(own.groupBy("y1", "x1", "y2", "x2").agg(F.min("edge_id").alias("edge_id")))
    released(edges.sparkSession)
    up = metres / DEGREE_METRES * 1.001
    size = max(int(0.5 / up / COARSE), 1)  # tiles to a degree
    around = 360 * size
    tile = lambda c: F.floor(c * size).cast("long")
    placed = lambda rows: rows.withColumns({"tx": F.pmod(F.col("cx"), F.lit(around)), "turn": F.floor(F.col("cx") / around)}).drop("cx")
    y1, y2, x1, x2 = (F.col(c) for c in ("y1", "y2", "x1", "x2"))
    rows = own.select("*", F.explode(F.sequence(tile(F.least(y1, y2)), tile(F.greatest(y1, y2)))).alias("ty"))
    low, high = F.greatest(F.least(y1, y2), F.col("ty") / size), F.least(F.greatest(y1, y2), (F.col("ty") + 1) / size)
    x = lambda y, flat: F.when(y1 == y2, flat).otherwise(x1 + (x2 - x1) * (y - y1) / F.when(y1 != y2, y2 - y1))
    lines = rows.select("*", x(low, x1).alias("a"), x(high, x2).alias("b"))
    lines = placed(lines.select("edge_id", "y1", "x1", "y2", "x2", "ty", F.explode(F.sequence(tile(F.least("a", "b")), tile(F.greatest("a", "b")))).alias("cx")))
    wide = F.least(F.lit(180.0), up / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + up, F.lit(90.0)))), F.lit(1e-9)))
    asked = points.select("lat", "lng").dropna().distinct().select("lat", "lng", wide.alias("wide"), F.explode(F.sequence(tile(F.col("lat") - up), tile(F.col("lat") + up))).alias("ty"))
    asked = placed(asked.select("*", F.explode(F.sequence(tile(F.col("lng") - F.col("wide")), tile(F.col("lng") + F.col("wide")))).alias("cx")))
    # Parts of a tile: each part of its edges meets each part of its points.
    parts = lambda rows, name: rows.groupBy("ty", "tx").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias(name))
    shared = tables.write(parts(lines, "n_edges").join(parts(asked, "n_points"), ["ty", "tx"]))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    key = ["ty", "tx", "p", "q"]
    lines = lines.join(shared, ["ty", "tx"]).withColumn("p", part("n_edges", "edge_id")).withColumn("q", each("n_points")).drop("n_edges", "n_points")
    asked = asked.join(shared, ["ty", "tx"]).withColumn("q", part("n_points", "lat", "lng")).withColumn("p", each("n_edges")).drop("n_edges", "n_points")
    meet = lambda p, e: candidates(p, e, 1 / size, up)
    hits = asked.groupBy(*key).cogroup(lines.groupBy(*key)).applyInPandas(meet, "lat double, lng double, edge_id long, y1 double, x1 double, y2 double, x2 double")
    shrink = F.cos(F.radians("lat"))
    ax, ay = turn_between(F.col("lng"), x1) * shrink, y1 - F.col("lat")
    dx, dy = (x2 - x1) * shrink, y2 - y1
    along = F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy))))
    hits = hits.withColumn("t", along)
    hits = hits.withColumn("metres", F.round(distance(F.col("lat"), F.col("lng"), y1 + (y2 - y1) * F.col("t"), x1 + (x2 - x1) * F.col("t")), 3)).where(F.col("metres") <= metres)
    best = hits.groupBy("lat", "lng").agg(F.min(F.struct("metres", "edge_id")).alias("best"))
    return points.select("query_id", "lat", "lng").join(best, ["lat", "lng"]).groupBy("query_id").agg(F.min("best").alias("best")).select("query_id", "best.edge_id", "best.metres")


def audit(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check, value): counts of what a sound graph has none of, and its size."""
    ids = nodes.select(F.col("node_id").alias("n"))
    lost = lambda c: edges.join(ids, edges[c] == ids["n"], "left_anti").agg(F.count("*").alias("value"))
    checks = {
        "edges": edges.agg(F.count("*").alias("value")),
        "nodes": nodes.agg(F.count("*").alias("value")),
        "missing_start": lost("start_node"),
        "missing_end": lost("end_node"),
        "loops": edges.agg(F.count_if(F.col("start_node") == F.col("end_node")).alias("value")),
        "duplicate_ids": edges.agg((F.count("*") - F.count_distinct("edge_id")).alias("value")),
    }
    out = None
    for name, rows in checks.items():
        one = rows.select(F.lit(name).alias("check"), "value")
        out = one if out is None else out.unionAll(one)
    return out


def groups(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, canonical) of the ends of (a, b): the smallest node that links reach. For groups of few nodes, as of one junction on several levels."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    best = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("canonical")))
    for _ in range(max_rounds):
        there = best.select(F.col("node").alias("b"), F.col("canonical").alias("theirs"))
        new = cut(both.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs")).join(best, "node").select("node", F.least("theirs", "canonical").alias("canonical")))
        if new.join(best, ["node", "canonical"], "left_anti").isEmpty():
            return new
        best = new
    raise ValueError(f"groups are more than {max_rounds} links wide")


class Automaton:
    """States of banned sequences of edges, with failure links already followed.

    The rules are configuration, few and bounded; the table is small enough to send to every task.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.banned = [False]
        for sequence in sequences:
            state = 0
            for e in sequence:
                if e not in self.next[state]:
                    self.next.append({})
                    self.banned.append(False)
                    self.next[state][e] = len(self.next) - 1
                state = self.next[state][e]
            self.banned[state] = True
        self.fail = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            self.banned[state] |= self.banned[self.fail[state]]
            for e, child in self.next[state].items():
                self.fail[child] = self.step(self.fail[state], e) if state else 0
                todo.append(child)

    def step(self, state: int, edge: int) -> int:
        while edge not in self.next[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.next[state][edge]

    def table(self, spark: SparkSession) -> DataFrame:
        """(state, edge_id, next_state, banned) for every state and every edge that a rule names."""
        alphabet = sorted({e for arcs in self.next for e in arcs})
        rows = [(s, e, t := self.step(s, e), self.banned[t]) for s in range(len(self.next)) for e in alphabet]
        return spark.createDataFrame(rows, "state int, edge_id long, next_state int, banned boolean")
