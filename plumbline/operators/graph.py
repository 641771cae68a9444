"""Lineage walks, set at a time, for all models together.

Edges are (src, dst, relationship, seq): src depends on dst; seq is the order in which the source
returned them. A walk goes level by level: the frontier joins the edges, nodes seen before are
taken out by an anti join, and of several ways to a new node the first in breadth-first order stays.
That order is the lexicographic order of the seq numbers along the path, so each level needs one
aggregation with partial sums and no ordering of all nodes. Levels are written tables; the loop ends
at the hop limit or when a level is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.operators import closure, reach

#: A hop of a path while it is walked: how the node was reached, from the model on.
HOP = "struct<urn:string,entity_type:string,via:string,column:string>"

#: Rounds of a column walk before it is left to ``closure``; most lineage is no deeper.
PLAIN = 4


@dataclass
class Counters:
    """What a walk fetched and had met before, counted as its levels are written, without a job of its own."""

    levels: list[tuple[Observation, Observation]] = field(default_factory=list)

    def level(self, reached: DataFrame, visited: DataFrame) -> DataFrame:
        """Of the ends of edges that a level reaches those not visited before, both counted."""
        both = Observation(), Observation()
        self.levels.append(both)
        one = F.count(F.lit(1)).alias("n")
        return reached.observe(both[0], one).join(visited, ["model_urn", "dst"], "left_anti").observe(both[1], one)

    def ends(self, sent: DataFrame) -> DataFrame:
        """The same for ends of edges of ``reach.walk``: each counts for every start that it came from."""
        both = Observation(), Observation()
        self.levels.append(both)
        number = lambda bits: F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).alias("n")
        return sent.observe(both[0], number(F.col("bits"))).observe(both[1], number(F.col("bits").bitwiseAND(F.bitwise_not(F.col("had")))))

    def totals(self) -> dict[str, int]:
        """fetched, met_before and levels of the walk, once it is over."""
        fetched, fresh = (sum(pair[i].get["n"] for pair in self.levels) for i in (0, 1))
        return {"levels": len(self.levels), "fetched": fetched, "met_before": fetched - fresh}


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges without loops and without feature tables as upstream ends, labelled."""
    named = edges.filter("src <> dst").withColumn("dst_type", X.entity_type(F.col("dst")))
    label = X.relationship(F.col("relationship"), X.entity_type(F.col("src")))
    return named.filter("dst_type <> 'mlFeatureTable'").select("src", "dst", "dst_type", label.alias("via"), "seq")


def footprint(models: DataFrame, edges: DataFrame, max_hops: int = 5, counters: Counters | None = None, paths: bool = True) -> DataFrame:
    """Every upstream asset of every model: model_urn, urn, entity_type, depth, and with ``paths`` place, chain, truncated.

    ``counters`` counts the ends of edges fetched, and how many of them an earlier level had met.

    ``models`` has the column model_urn. ``chain`` runs from the model to the asset (an array of
    HOP whose via is the label of the edge into it). ``truncated`` marks nodes at the hop limit that
    have upstream nodes beyond it which no path reached. Without ``paths`` a level has a row for each node and 64 models,
    as of ``reach.walk``, whatever the number of ways to it.
    """
    ways = cut(clean_edges(edges), "edges")
    if not paths:
        known = cut(reach.numbered(models.select(F.col("model_urn").alias("seed")), reach.WORD), "models")
        levels = reach.walk(known, ways.select(F.col("src").alias("from"), F.col("dst").alias("to")), max_hops, count=counters and counters.ends)
        return reach.spelled(levels, known).select(F.col("start").alias("model_urn"), "urn", X.entity_type(F.col("urn")).alias("entity_type"), "depth")
    hop = lambda urn, kind, via: F.struct(urn.alias("urn"), kind.alias("entity_type"), via.alias("via"), F.lit(None).cast("string").alias("column"))
    root_type = X.entity_type(F.col("model_urn"))
    level = models.select(F.col("model_urn")).distinct().select(
        "model_urn",
        F.col("model_urn").alias("urn"),
        root_type.alias("entity_type"),
        F.lit(0).alias("depth"),
        F.array(hop(F.col("model_urn"), root_type, F.lit(None).cast("string"))).alias("chain"),
        F.array().cast("array<bigint>").alias("place"),
    )
    level = cut(level, "level")
    levels = [level]
    for depth in range(1, max_hops + 1):
        reached = level.select("model_urn", F.col("urn").alias("src"), "chain", "place").join(ways, "src")
        visited = reduce(DataFrame.unionByName, [x.select("model_urn", F.col("urn").alias("dst")) for x in levels])
        fresh = reached.join(visited, ["model_urn", "dst"], "left_anti") if counters is None else counters.level(reached, visited)
        found = fresh.select(
            "model_urn",
            "dst",
            F.struct(
                F.concat("place", F.array(F.col("seq").cast("bigint"))).alias("place"),
                F.concat("chain", F.array(hop(F.col("dst"), F.col("dst_type"), F.col("via")))).alias("chain"),
                F.col("dst_type").alias("entity_type"),
            ).alias("way"),
        )
        first = found.groupBy("model_urn", "dst").agg(F.min("way").alias("way"))
        level = cut(
            first.select("model_urn", F.col("dst").alias("urn"), F.col("way.entity_type"), F.lit(depth).alias("depth"), F.col("way.chain"), F.col("way.place")),
            "level",
        )
        if not level.limit(1).count():
            break
        levels.append(level)
    whole = reduce(DataFrame.unionByName, levels)
    edge_nodes = whole.filter(F.col("depth") == max_hops).select("model_urn", F.col("urn").alias("src"))
    beyond = edge_nodes.join(ways.select("src", "dst"), "src").join(whole.select("model_urn", F.col("urn").alias("dst")), ["model_urn", "dst"], "left_anti")
    cut_short = beyond.select("model_urn", F.col("src").alias("urn")).distinct().withColumn("cut_short", F.lit(True))
    out = whole.join(cut_short, ["model_urn", "urn"], "left").withColumn("truncated", F.coalesce("cut_short", F.lit(False)))
    return out.select("model_urn", "urn", "entity_type", "depth", "place", "chain", "truncated")


def hops(found: DataFrame) -> DataFrame:
    """Adds the path from root cause to model: each hop's via is the label of the hop before it in that order."""
    turned = F.reverse("chain")
    path = F.transform(
        turned,
        lambda h, i: F.struct(
            h["urn"].alias("urn"), h["entity_type"].alias("entity_type"), F.when(i > 0, F.get(turned, i - 1)["via"]).alias("via"), h["column"].alias("column")
        ),
    )
    return found.withColumn("hops", path)


def feature_sources(found: DataFrame, edges: DataFrame, max_hops: int = 5) -> DataFrame:
    """(model_urn, urn, feeds_features): features that datasets of the footprint source directly.

    Only features that the walk expanded count, those before the hop limit.
    """
    features = found.filter((F.col("entity_type") == "mlFeature") & (F.col("depth") < max_hops)).select("model_urn", F.col("urn").alias("src"))
    sourced = features.join(clean_edges(edges).filter("dst_type = 'dataset'"), "src").select("model_urn", F.col("dst").alias("urn"), F.col("src").alias("feature"))
    sourced = sourced.join(found.select("model_urn", "urn"), ["model_urn", "urn"], "left_semi")
    return sourced.groupBy("model_urn", "urn").agg(F.array_sort(F.collect_set("feature")).alias("feeds_features"))


def column_features(found: DataFrame, sources: DataFrame, columns: DataFrame, column_edges: DataFrame) -> DataFrame:
    """(model_urn, urn, path, features): features that each upstream column reaches by column lineage.

    Starts from all columns of datasets that source features (``sources``) and follows
    ``column_edges`` (down_urn, down_col, up_urn, up_col) inside the footprint without a hop limit. The first PLAIN
    rounds join the triples that were new in the one before; what goes on after them, long chains and cycles, is
    left to ``closure``, whose rounds grow with the logarithm of the longest chain.
    """
    seeds = sources.join(columns.select("model_urn", "urn", "path").distinct(), ["model_urn", "urn"])
    seeds = seeds.select("model_urn", "urn", "path", F.explode("feeds_features").alias("seed"))
    known = cut(reach.numbered(sources.select(F.explode("feeds_features").alias("seed")), reach.WORD), "features")
    inside = cut(found.select("model_urn", "urn"), "inside")
    ways = cut(column_edges.select(F.col("down_urn").alias("urn"), F.col("down_col").alias("path"), "up_urn", "up_col"), "ways")
    key, none = ["model_urn", "urn", "path", "block"], F.lit(0).cast("bigint")
    first = seeds.join(known, "seed").groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("met"))
    # A row for each column and 64 features, by bits: those met so far, those that came over an edge, and those met first in the last round.
    state = cut(first.select(*key, "met", none.alias("got"), F.col("met").alias("fresh")), "seeds")
    further = None
    for _ in range(PLAIN):
        up = state.filter("fresh <> 0").join(ways, ["urn", "path"]).select("model_urn", F.col("up_urn").alias("urn"), F.col("up_col").alias("path"), "block", F.col("fresh").alias("sent"))
        up = up.groupBy(*key).agg(F.bit_or("sent").alias("sent")).join(inside, ["model_urn", "urn"], "left_semi")
        both = up.select(*key, none.alias("met"), none.alias("got"), "sent").unionByName(state.select(*key, "met", "got", none.alias("sent")))
        both = both.groupBy(*key).agg(*(F.bit_or(c).alias(c) for c in ("met", "got", "sent")))
        met, got, sent = (F.col(c) for c in ("met", "got", "sent"))
        state = cut(both.select(*key, met.bitwiseOR(sent).alias("met"), got.bitwiseOR(sent).alias("got"), sent.bitwiseAND(F.bitwise_not(met)).alias("fresh")), "reached")
        if not state.filter("fresh <> 0").limit(1).count():
            break
    else:
        bit = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(fresh, i) & 1L) = 1L)")).alias("bit")
        new = state.filter("fresh <> 0").select(*key, bit).join(known, ["block", "bit"])
        further = _further(new.select("model_urn", "urn", "path", F.col("seed").alias("feature")), ways, inside)
    names = known.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "seed"))), lambda x: x["seed"]).alias("names"))
    named = state.filter("got <> 0").join(names, "block")
    whole = named.select("model_urn", "urn", "path", F.expr("transform(filter(sequence(0, 63), i -> (shiftright(got, i) & 1L) = 1L), i -> names[i])").alias("features"))
    if further is not None:
        whole = whole.unionByName(further.select("model_urn", "urn", "path", F.array("feature").alias("features")))
    return whole.groupBy("model_urn", "urn", "path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("features"))


def _further(new: DataFrame, ways: DataFrame, inside: DataFrame) -> DataFrame:
    """All that the triples ``new`` (model_urn, urn, path, feature) reach along ``ways`` inside the footprints."""
    both = ways.join(inside, "urn").join(inside.withColumnRenamed("urn", "up_urn"), ["model_urn", "up_urn"])
    both = cut(both.select("model_urn", "urn", "path", "up_urn", "up_col").distinct(), "inner")
    ends = both.select("model_urn", "urn", "path").unionByName(both.select("model_urn", F.col("up_urn").alias("urn"), F.col("up_col").alias("path")))
    nodes = cut(ends.distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    upper = nodes.select("model_urn", F.col("urn").alias("up_urn"), F.col("path").alias("up_col"), F.col("node").alias("b"))
    edges = both.join(nodes.withColumnRenamed("node", "a"), ["model_urn", "urn", "path"]).join(upper, ["model_urn", "up_urn", "up_col"])
    starts = new.join(nodes, ["model_urn", "urn", "path"]).select("node", F.col("feature").alias("item"))
    held, _ = closure.closure(starts, cut(edges.select("a", "b").distinct(), "edges"))
    return held.join(nodes, "node").select("model_urn", "urn", "path", F.col("item").alias("feature"))


def downstream_models(seeds: DataFrame, edges: DataFrame, max_hops: int = 6, paths: bool = True) -> DataFrame:
    """Models downstream of each seed (column seed): seed, model_urn, depth, and with ``paths`` path (array from the seed on).

    Models end a walk; other entity types than TRAVERSABLE are not walked through. ``edges`` are
    those of ``footprint``, walked the other way, for all seeds together as bitmaps.
    """
    return reach.reached(seeds, edges, "mlModel", max_hops, paths).withColumnRenamed("urn", "model_urn")


def route(path) -> object:
    """The names along a path after its start."""
    names = F.transform(path, lambda u: X.report_name(u))
    return F.array_join(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))), " → ")


def attribute(findings: DataFrame, found: DataFrame, owners: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Findings with the path to their model, the owners of its root, and a feature from the path.

    ``found``: a footprint; ``owners``: (model_urn, urn, owners); ``queries``: (urn, query_sql). The
    root hop takes the finding's column. A finding off the footprint is ``unattributed``.
    """
    paths = hops(found).select("model_urn", F.col("urn").alias("subject_urn"), "hops")
    out = findings.join(paths, ["model_urn", "subject_urn"], "left")
    own = owners.select("model_urn", F.col("urn").alias("subject_urn"), F.col("owners").alias("path_owners"))
    out = out.join(own, ["model_urn", "subject_urn"], "left")
    if queries is not None:
        out = out.join(queries.select(F.col("urn").alias("subject_urn"), "query_sql"), "subject_urn", "left")
        out = out.withColumn("query_sql", F.when(F.col("hops").isNotNull(), F.col("query_sql")))
    named = F.transform("hops", lambda h, i: F.when((i == 0) & F.col("subject_column").isNotNull(), h.withField("column", F.col("subject_column"))).otherwise(h))
    on_path = F.get(F.filter(F.reverse("hops"), lambda h: h["entity_type"] == "mlFeature"), F.lit(0))["urn"]
    return (
        out.withColumn("unattributed", F.col("hops").isNull())
        .withColumn("affected_feature_urn", F.coalesce("affected_feature_urn", on_path))
        .withColumn("hops", named)
        .withColumn("root_urn", F.get("hops", F.lit(0))["urn"])
        .withColumn("path_depth", F.when(F.col("hops").isNotNull(), F.greatest(F.size("hops") - 1, F.lit(0))))
        .withColumn("path_owners", F.when(F.col("hops").isNotNull(), F.coalesce("path_owners", F.array().cast("array<string>"))))
    )
