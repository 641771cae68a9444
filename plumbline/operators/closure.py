"""What items reach over a directed graph, in rounds that grow with the logarithm of its longest chain.

Nodes are whole numbers; an item starts at nodes and passes along the edges. A round sends new items along
the edges and all shortcuts, and old ones along the newest shortcuts. These join those of the round before two by
two, so they lead 2, 4, 8, ... edges on. Two things keep them few:

* Condensation: nodes that edges or shortcuts join both ways are on a cycle and reach the same. All but one of them give way to the
  smallest of their partners, in edges, shortcuts and items; ``members`` keeps who stands for whom.
* Shortcuts lead only over nodes of which in-degree times out-degree is WIDE at most, so a round makes WIDE of them a node
  at most. Hubs pass items on by their edges.

Edges are never left out, so a round in which nothing new is reached ends the work, whatever shortcuts
there are: what is reached then is closed under the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.durable import cut

#: Shortcuts over one node at most.
WIDE = 64

#: Rounds before there are any, as most graphs are shallow.
PLAIN = 3


def _renamed(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``df`` with the nodes of ``column`` under the names (node, leader) that ``names`` has for some."""
    own = names.select(F.col("node").alias(column), F.col("leader").alias("leader_"))
    out = df.join(own, column, "left")
    return out.withColumn(column, F.coalesce("leader_", column)).drop("leader_")


def shortcuts(ways: DataFrame) -> DataFrame:
    """(a, b) two steps apart, over nodes that are not too wide."""
    into, out = ways.groupBy(F.col("b").alias("m")).agg(F.count(F.lit(1)).alias("n_in")), ways.groupBy(F.col("a").alias("m")).agg(F.count(F.lit(1)).alias("n_out"))
    thin = into.join(out, "m").filter(F.col("n_in") * F.col("n_out") <= WIDE).select("m")
    first = ways.select("a", F.col("b").alias("m")).join(thin, "m")
    return first.join(ways.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()


def mutual(ways: DataFrame) -> DataFrame:
    """(node, leader): nodes that reach a smaller one which reaches them."""
    back = ways.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = ways.filter("b < a").join(back, ["a", "b"], "left_semi")
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("leader"))


def _stand_in(members: DataFrame | None, names: DataFrame) -> DataFrame:
    """``members`` (node, leader) after leaders, or nodes that still stood for themselves, gave way as ``names`` says.

    A name that was given away can have been given to other nodes, so only nodes without an entry get one.
    """
    if members is None:
        return names
    next_one = names.select(F.col("node").alias("leader"), F.col("leader").alias("onward"))
    moved = members.join(next_one, "leader", "left").select("node", F.coalesce("onward", "leader").alias("leader"))
    return moved.unionByName(names.join(members.select("node"), "node", "left_anti"))


def closure(starts: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, item) that items reach over one edge or more, and the number of rounds.

    ``starts``: (node, item); ``edges``: (a, b), written, as each of the first rounds reads them. Of equal rows one counts.
    """
    ways = edges.select("a", "b")
    held = cut(starts.join(ways, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "item").distinct(), "held")
    send = lambda items, along: items.join(along, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "item")
    long, fresh, members, rounds = None, held, None, 0
    while True:
        rounds += 1
        names = cut(mutual(ways), "leaders") if long is not None else None
        if names is not None and names.limit(1).count():
            rename = lambda df: cut(_renamed(_renamed(df, "a", names), "b", names).distinct(), "renamed")
            ways, long, held = rename(ways), rename(long), cut(_renamed(held, "node", names).distinct(), "held")
            members = cut(_stand_in(members, names), "members")
            sent = send(held, ways)
        else:
            sent = send(fresh, ways) if long is None else send(fresh, ways).unionByName(send(held, long))
        fresh = cut(sent.distinct().join(held, ["node", "item"], "left_anti"), "new")
        if not fresh.limit(1).count():
            break
        held = cut(held.unionByName(fresh), "held")
        if rounds < PLAIN:
            continue
        if long is None:
            ways = cut(ways.distinct(), "edges")
        long = cut(shortcuts(ways if long is None else long), "shortcuts")
        ways = cut(ways.unionByName(long).distinct(), "ways")
    if members is None:
        return held, rounds
    own = held.select(F.col("node").alias("leader"), "item")
    led = members.join(own, "leader").select("node", "item")
    return held.join(members.select("node"), "node", "left_anti").unionByName(led), rounds
