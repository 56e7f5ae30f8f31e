"""Walks over the graph: reach, shortest paths, communities.  Loops run on the driver, data stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import settle
from codeloom.session import pin

#: So many links are clustered by one task; with 10 million of 880,000 nodes its Python worker took 493 MB.
ONE_TASK = 11_000_000

def downstream(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of nodes reached from ``start`` (id) in up to ``depth`` steps, each at its least depth, the start left out."""
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    steps = edges.select("source", "target").distinct()
    for k in range(1, depth + 1):
        found = steps.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        front = pin(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id) of direct predecessors of ``start``, the start itself left out."""
    return edges.join(start.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct().join(start.select("id"), "id", "left_anti")


def shortest_path(edges: DataFrame, source: str, target: str, most: int | None = None) -> DataFrame:
    """(place, id) of the shortest directed path, of several the one whose ids are smallest from the end backwards.

    Empty if there is none, or none within ``most`` steps where that is given; a node's path to itself is the node.
    The search ends when nothing new is reached.  Each round keeps one parent per node reached, so the state is one
    row a node.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(source, None, 0)], "id string, parent string, depth int")
    if source != target:
        steps, front = edges.select("source", "target").distinct(), seen
        k = 0
        while True:
            k += 1
            if most is not None and k > most:
                return spark.createDataFrame([], "place int, id string")
            found = steps.join(front.select(F.col("id").alias("source")), "source").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
            front = pin(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)), "front")
            if front.isEmpty():
                return spark.createDataFrame([], "place int, id string")
            seen = seen.unionByName(front)
            if not front.where(F.col("id") == target).isEmpty():
                break
    path, at = [], target
    while at is not None:  # one row a step
        row = seen.where(F.col("id") == at).first()
        path.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(sorted(path), "place int, id string")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a < b)."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, community) after a fixed number of synchronous rounds.

    A node takes the commonest label among its neighbours and itself, the smallest of equals; labels begin as ids.
    Votes are combined before the shuffle, so a node of very high degree is no hot spot.
    """
    pairs = undirected(edges)
    both = pin(pairs.selectExpr("a as id", "b as other").unionByName(pairs.selectExpr("b as id", "a as other")), "neighbours")
    labels = both.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("other"), "label"), "other").select("id", "label").unionByName(labels)
        counted = votes.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
        # the greatest count, and of those the smallest label
        best = counted.groupBy("id").agg(F.max("n").alias("n")).join(counted, ["id", "n"]).groupBy("id").agg(F.min("label").alias("label"))
        labels = pin(best, "labels")
    return labels.select("id", F.col("label").alias("community"))


def _moved(own: DataFrame, moves: DataFrame) -> DataFrame:
    """(n, c) after the moves (u, c)."""
    return pin(own.join(moves.select(F.col("u").alias("n"), F.col("c").alias("to")), "n", "left").select("n", F.coalesce("to", "c").alias("c")), "own")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v", "w").unionByName(links.where("u <> v").selectExpr("v as u", "u as v", "w"))


def _block_moves(links: DataFrame, strength: DataFrame, own: DataFrame, total: int, parts: int, turn: int, rounds: int) -> DataFrame:
    """(n, c) after moves within blocks of communities, dealt to ``parts`` tasks anew each ``turn``.

    A task has its communities whole and moves their nodes among these only, so the gains of all tasks add up.
    """
    placed = own.withColumn("block", F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(parts)).cast("int"))
    nodes = placed.join(strength, "n").select("block", F.col("n").alias("u"), F.col("n").alias("v"), F.col("k").alias("w"), "c")
    a, b = placed.select(F.col("n").alias("u"), "block"), placed.select(F.col("n").alias("v"), "block")
    inner = _both_ways(links.where("u <> v").join(a, "u").join(b, ["v", "block"]).select("u", "v", "w")).join(a, "u").select("block", "u", "v", "w", F.lit(None).cast("int").alias("c"))
    rows = nodes.unionByName(inner).repartitionById(parts, F.col("block")).select("u", "v", "w", "c").sortWithinPartitions("u", "v")
    return pin(rows.mapInArrow(settle.block_of(total, rounds), "n int, c int, settled boolean").select("n", "c"), "own")


def louvain(edges: DataFrame, levels: int = 50, rounds: int = 1000) -> DataFrame:
    """(id, community) of a greedy modularity clustering in levels; communities are named by their smallest member.

    Up to ``ONE_TASK`` links all levels are settled by one task, node after node (``settle.cluster``): in the result no
    node and no community has a move that raises the modularity.

    Above that a level is spread.  Blocks of communities are settled apart, in ever other blocks, while one in a hundred
    nodes moves.  What is left moves in rounds: every group to the neighbour group with the greatest gain, but only to a
    smaller one in even rounds and to a greater one in odd rounds, so that two never swap.  Where moves made together would
    not raise the modularity, only those are made that are the best of both their communities: they share none, so their
    gains add up, and the rounds end.  When no move has a gain, groups become the nodes of the next level.

    Gains are whole numbers, so none is too small to count.  More than ``levels`` or ``rounds`` are an error.
    """
    pairs = pin(undirected(edges), "pairs")
    names = pin(_numbered(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"), "names")
    a, b = names.select(F.col("id").alias("a"), F.col("number").alias("u")), names.select(F.col("id").alias("b"), F.col("number").alias("v"))
    links = pin(pairs.join(a, "a").join(b, "b").select("u", "v", F.lit(1).cast("long").alias("w")), "links")
    total = size = links.count()
    if not total:
        return names.select("id", F.col("id").alias("community"))
    members = names.select("id", F.col("number").alias("node"))
    for level in range(levels):
        if size <= ONE_TASK:
            rows = _both_ways(links).withColumn("c", F.lit(None).cast("int")).repartition(1).sortWithinPartitions("u", "v")
            found = pin(rows.mapInArrow(settle.levels_of(total, levels - level, rounds), "n int, c int, settled boolean"), "found")
            if not found.where("not settled").isEmpty():
                raise RuntimeError("communities did not settle")
            members = members.join(found.select(F.col("n").alias("node"), "c"), "node").select("id", F.col("c").alias("node"))
            break
        both = pin(_both_ways(links), "both")
        strength = pin(both.where("u <> v").selectExpr("u as n", "w").unionByName(links.where("u = v").selectExpr("u as n", "2 * w as w")).groupBy("n").agg(F.sum("w").alias("k")), "strength")
        own = strength.select("n", F.col("n").alias("c"))
        moved_any, quiet, n_nodes, parts = False, 0, strength.count(), -(-size // ONE_TASK)
        for turn in range(rounds):
            after = _block_moves(links, strength, own, total, parts, turn, rounds)
            n_moved = after.join(own.withColumnRenamed("c", "was"), "n").where("c <> was").count()
            own, moved_any = after, moved_any or n_moved > 0
            if n_moved * 100 < n_nodes:
                break

        def quality(groups: DataFrame) -> int:
            """The modularity times 4 total * total."""
            inner = links.join(groups.selectExpr("n as u", "c as cu"), "u").join(groups.selectExpr("n as v", "c as cv"), "v").where("cu = cv").agg(F.sum("w")).first()[0] or 0
            k = F.col("k").cast("decimal(19,0)")
            squares = groups.join(strength, "n").groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(k * k)).first()[0]
            return 4 * total * inner - int(squares)

        reached = quality(own)
        for r in range(rounds):
            sums = own.join(strength, "n").groupBy("c").agg(F.sum("k").alias("sum_k"))
            toward = both.where("u <> v").join(own.select(F.col("n").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            here = own.select(F.col("n").alias("u"), F.col("c").alias("now"))
            base = here.join(strength.select(F.col("n").alias("u"), "k"), "u").join(sums.select(F.col("c").alias("now"), F.col("sum_k").alias("own_k")), "now")
            inside = toward.select("u", F.col("c").alias("now"), F.col("w").alias("own_w"))
            options = toward.join(base, "u").join(inside, ["u", "now"], "left").join(sums, "c").where(F.col("c") < F.col("now") if r % 2 == 0 else F.col("c") > F.col("now"))
            gain = 2 * total * (F.col("w") - F.coalesce("own_w", F.lit(0))) - F.col("k") * (F.col("sum_k") - F.col("own_k") + F.col("k"))
            best = options.withColumn("gain", gain).where("gain > 0").groupBy("u", "now").agg(F.max(F.struct("gain", "c")).alias("m")).select("u", "now", "m.c", "m.gain")
            moves = pin(best, "moves")
            if moves.isEmpty():
                quiet += 1
                if quiet == 2:  # neither direction has a gain
                    break
                continue
            quiet, moved_any = 0, True
            after = _moved(own, moves)
            value = quality(after)
            if value <= reached:
                touched = moves.select("u", F.struct("gain", "u").alias("rank"), F.explode(F.array("now", "c")).alias("of"))
                first = touched.groupBy("of").agg(F.max("rank").alias("rank")).select("of", F.col("rank.u").alias("u"))
                alone = first.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("u")
                after = _moved(own, moves.join(alone, "u", "left_semi"))
                value = quality(after)
            own, reached = after, value
        else:
            raise RuntimeError("communities did not settle")
        if not moved_any:
            break
        members = pin(members.join(own.select(F.col("n").alias("node"), "c"), "node").select("id", F.col("c").alias("node")), "members")
        a, b = own.selectExpr("n as u", "c as cu"), own.selectExpr("n as v", "c as cv")
        links = pin(links.join(a, "u").join(b, "v").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")), "links")
        size = links.count()
    else:
        raise RuntimeError("communities did not settle")
    names = members.groupBy("node").agg(F.min("id").alias("community"))
    return members.join(names, "node").select("id", "community")


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    pairs = undirected(edges)
    a, b = groups.select(F.col("id").alias("a"), F.col("community").alias("ca")), groups.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    placed = pairs.join(a, "a").join(b, "b")
    m = placed.count()
    inner = placed.where("ca = cb").count()
    k = placed.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inner / m - k / (4.0 * m * m) if m else 0.0


def _numbered(names: DataFrame, by: str) -> DataFrame:
    """Distinct values of the column ``by`` with their number in its order from 0, without sorting all in one task."""
    spread = pin(names.repartitionByRange(by).withColumn("part", F.spark_partition_id()), "names")
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    return spread.join(before, "part").withColumn("number", (F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1 + F.col("before")).cast("int")).select(by, "number")


def consecutive(groups: DataFrame) -> DataFrame:
    """(id, community int): communities numbered from 0 by their names, without sorting all in one task."""
    numbered = _numbered(groups.select("community").distinct(), "community")
    return groups.join(numbered, "community").select("id", F.col("number").alias("community"))
