"""Column lineage of a statement, read off its analyzed plan, and the models that a column feeds.

Every node of the analyzed plan says which of its outputs come from which inputs: select lists, aggregates and
windows by their expressions, unions and grouping sets by position, common table expressions by their definition, generators by
what they read; all others pass their inputs on. Expressions hand on the columns of their subqueries too. A view or
table is where a column comes from; the inside of a view isn't looked at.

The walk down is by columns as far as the catalog has column lineage between two tables; where a table builds
on another without any, all its columns count as fed. From the first entity that is no dataset on, models are
found by the table graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.functions.durable import cut
from plumbline.operators import closure, reach

#: All columns of a table, as a node of the column walk.
WHOLE = "*"

_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


class _Plan:
    """The sources (table, column, whether a plain copy) of each output of a plan's nodes, by expression id."""

    def __init__(self):
        self.defined: dict[int, list[frozenset]] = {}

    def outputs(self, plan) -> dict[int, frozenset]:
        kind, out = _kind(plan), _items(plan.output())
        ids = [a.exprId().id() for a in out]
        if kind == "WithCTE":
            for definition in _items(plan.cteDefs()):
                inner = self.outputs(definition.child())
                self.defined[definition.id()] = [inner[a.exprId().id()] for a in _items(definition.child().output())]
            return self.outputs(plan.plan())
        if kind == "CTERelationRef":
            return dict(zip(ids, self.defined.get(plan.cteId(), [frozenset()] * len(ids))))
        children = [] if kind == "View" else _items(plan.children())
        if not children:
            name = plan.desc().identifier().table() if kind == "View" else self._table(plan)
            return {i: frozenset({(name, a.name(), True)}) for i, a in zip(ids, out)}
        below = [self.outputs(c) for c in children]
        if kind in ("Union", "Intersect", "Except"):
            by_place = [[b[a.exprId().id()] for a in _items(c.output())] for c, b in zip(children, below)]
            return {i: frozenset().union(*(b[at] for b in by_place)) for at, i in enumerate(ids)}
        known = reduce(lambda a, b: a | b, below)
        if kind == "Expand":
            rows = [_items(p) for p in _items(plan.projections())]
            return {i: frozenset().union(*(self.sources(p[at], known) for p in rows)) for at, i in enumerate(ids)}
        own, read = {}, frozenset()
        for e in _items(plan.expressions()):
            read |= self.sources(e, known)
            self._named(e, known, own)
        return {i: own[i] if i in own else known[i] if i in known else _made(read) for i in ids}

    def _named(self, e, known, own) -> None:
        if _kind(e) == "Alias":
            own[e.exprId().id()] = self.sources(e, known)
        for c in _items(e.children()):
            self._named(c, known, own)

    def sources(self, e, known: dict[int, frozenset]) -> frozenset:
        """Those of an expression; a column under its own or another name is a plain copy of what it was."""
        kind = _kind(e)
        if kind == "AttributeReference":
            return known.get(e.exprId().id(), frozenset())
        if kind == "Alias" and _kind(e.child()) in ("AttributeReference", "Alias"):
            return self.sources(e.child(), known)
        found = frozenset().union(*(self.sources(c, known) for c in _items(e.children())))
        if kind == "OuterReference":
            found |= self.sources(e.e(), known)
        if kind in _SUBQUERIES:
            found |= frozenset().union(*self.outputs(e.plan()).values())
        return _made(found)

    @staticmethod
    def _table(plan) -> str:
        try:
            table = plan.catalogTable()
            return table.get().identifier().table() if table.isDefined() else _kind(plan)
        except Exception:  # leaves that are no table of the catalog
            return _kind(plan)


def _made(sources: frozenset) -> frozenset:
    return frozenset((t, c, False) for t, c, _ in sources)


def of_plan(analyzed) -> tuple[tuple[str, str, str, bool], ...]:
    """(output, table, column, copied) of an analyzed plan, in the order of its outputs."""
    found = _Plan().outputs(analyzed)
    return tuple((a.name(), *s) for a in _items(analyzed.output()) for s in sorted(found[a.exprId().id()]))


def column_impact(seeds: DataFrame, edges: DataFrame, column_edges: DataFrame, max_hops: int = 6) -> DataFrame:
    """(table_urn, path, model_urn): the models that each column (table_urn, path) feeds.

    ``edges``: (src, dst, seq), src builds on dst; ``column_edges``: (down_urn, down_col, up_urn, up_col).
    ``max_hops`` counts from the last dataset on.
    """
    seeds = cut(seeds.select(F.col("table_urn").alias("urn"), "path").distinct(), "columns")
    named = cut(column_edges.select(F.col("up_urn").alias("urn"), F.col("up_col").alias("path"), F.col("down_urn").alias("to"), F.col("down_col").alias("to_path")), "named")
    n_seeds = seeds.count()
    models = _near(seeds, edges, named, max_hops) if n_seeds <= reach.FEW else None
    if models is None:
        # Users without column lineage, and all edges of which an end is no dataset.
        ways = edges.select("src", "dst").filter("src <> dst")
        pairs = named.select(F.col("to").alias("src"), F.col("urn").alias("dst")).filter(_dataset("src") & _dataset("dst"))
        # Names begin alike, so pairs are sorted by a hash before them.
        hashed = lambda df: df.withColumn("h", F.xxhash64("src", "dst"))
        loose = cut(hashed(ways).join(hashed(pairs), ["h", "src", "dst"], "left_anti").select("src", "dst").distinct(), "loose")
        blind = loose.filter(_dataset("src") & _dataset("dst")).select(F.col("dst").alias("urn"), F.col("src").alias("to"))
        served = _served(loose, loose, edges, max_hops)
        steps = _steps(seeds, named, blind)
        n_models = served.select("model_urn").distinct().count()
        models = _fed(seeds, steps, served) if n_seeds <= n_models * reach.FORWARD else _feeding(seeds, steps, served)
    return models.select(F.col("urn").alias("table_urn"), "path", "model_urn")


def _dataset(c: str) -> Column:
    """``exprs.entity_type`` of a name is dataset."""
    return F.col(c).startswith("urn:li:dataset:") | (F.col(c) == "urn:li:dataset")


def _node(urn: str, path: str) -> Column:
    return F.struct(F.col(urn).alias("urn"), F.col(path).alias("path"))


def _linked(steps: DataFrame) -> DataFrame:
    return steps.filter("urn is not null and to is not null").select(_node("urn", "path").alias("a"), _node("to", "to_path").alias("b"))


def _steps(seeds: DataFrame, named: DataFrame, blind: DataFrame) -> DataFrame:
    """(urn, path, to, to_path): column lineage, and tables that count as fed as a whole."""
    whole = seeds.filter(F.col("path") == WHOLE).select("urn").unionByName(named.filter(F.col("to_path") == WHOLE).select(F.col("to").alias("urn")))
    # Tables that can count as fed as a whole: by a table without column lineage, or as a column of that name.
    marked = cut(whole.unionByName(blind.select(F.col("to").alias("urn"))).distinct(), "marked")
    if not marked.limit(1).count():
        return named
    # A whole table feeds what any of its columns feeds.
    of_whole = named.join(marked, "urn", "left_semi").select("urn", F.lit(WHOLE).alias("path"), "to", "to_path")
    columns = named.select(F.col("to").alias("urn"), F.col("to_path").alias("path")).unionByName(seeds)
    columns = columns.unionByName(marked.withColumn("path", F.lit(WHOLE))).join(blind.select("urn"), "urn", "left_semi").distinct()
    unnamed = columns.join(blind, "urn").select("urn", "path", "to", F.lit(WHOLE).alias("to_path"))
    return cut(named.unionByName(of_whole).unionByName(unnamed), "steps")


def _served(users: DataFrame, around: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(urn, model_urn): the models that each table's users which are no datasets belong to.

    ``users``: (src, dst), of which those count; ``around``: at least all edges to what is no dataset. Where no dataset builds on such, a
    walk from them has no need of others.
    """
    outside = cut(users.filter(~_dataset("src")).distinct(), "outside")
    around = around.filter(~_dataset("dst"))
    back = around.filter(_dataset("src")).limit(1).count()
    along = edges if back else around.withColumn("seq", F.lit(0))
    beyond = reach.reached(outside.select(F.col("src").alias("seed")), along, "mlModel", max_hops, paths=False).select(F.col("seed").alias("src"), F.col("urn").alias("model_urn"))
    own = outside.filter(X.entity_type(F.col("src")) == "mlModel").select("src", F.col("src").alias("model_urn"))
    return cut(outside.join(beyond.unionByName(own), "src").select(F.col("dst").alias("urn"), "model_urn").distinct(), "served")


def _near(seeds: DataFrame, edges: DataFrame, named: DataFrame, max_hops: int) -> DataFrame | None:
    """(urn, path, model_urn) of few columns by column lineage alone, or None where that isn't all.

    It is all if no column that they reach is a whole table, and no table of these has a user without column lineage.
    """
    starts = seeds.select(_node("urn", "path").alias("node"), _node("urn", "path").alias("item"))
    fed, _ = closure.closure(starts, _linked(named))
    fed = cut(fed.unionByName(starts).distinct(), "fed")
    if fed.filter(F.col("node.path") == WHOLE).limit(1).count():
        return None
    tables = cut(fed.select(F.col("node.urn").alias("dst")).distinct(), "tables")
    ways = edges.select("src", "dst").filter("src <> dst")
    users = cut(ways.join(tables, "dst", "left_semi"), "users")
    pairs = named.select(F.col("to").alias("src"), F.col("urn").alias("dst")).join(tables, "dst", "left_semi")
    if users.filter(_dataset("src") & _dataset("dst")).join(pairs, ["src", "dst"], "left_anti").limit(1).count():
        return None
    served = _served(users, cut(ways.filter(~_dataset("dst")), "around"), edges, max_hops)
    return _models_of(fed, served)


def _models_of(fed: DataFrame, served: DataFrame) -> DataFrame:
    tables = fed.select("item", F.col("node.urn").alias("urn")).distinct()
    return tables.join(served, "urn").select("item", "model_urn").distinct().select("item.*", "model_urn")


def _fed(seeds: DataFrame, steps: DataFrame, served: DataFrame) -> DataFrame:
    """(urn, path, model_urn) by a walk down from the columns."""
    starts = seeds.select(_node("urn", "path").alias("node"), _node("urn", "path").alias("item"))
    return _models_of(closure.closure(starts, _linked(steps))[0].unionByName(starts), served)


def _feeding(seeds: DataFrame, steps: DataFrame, served: DataFrame) -> DataFrame:
    """(urn, path, model_urn) by a walk up from the models, with words of them.

    All steps to a table that models have a use of are taken at once. Only steps to a column that others come from too
    go on from there, and where most lead to the last tables before the models these are few. Names take a hundredth of their
    size on disk, by which Spark would broadcast millions of them, so joins by column have hints.
    """
    known = cut(reach.numbered(served.select(F.col("model_urn").alias("seed")), reach.WORD), "models")
    bits = served.join(known, F.col("model_urn") == F.col("seed")).groupBy("urn", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = cut(bits.select("urn", "block", "bits"), "served_bits")
    steps = steps.filter("urn is not null and to is not null")
    # Rows meet before they are added up: columns are dealt over all files, so a task by itself would hold nearly each of them.
    sent = steps.join(bits.withColumnRenamed("urn", "to"), "to", "left").select("urn", "path", "block", "bits").repartition("urn", "path")
    first = cut(sent.groupBy("urn", "path", "block").agg(F.bit_or("bits").alias("bits")), "first")
    into = first.select(_node("urn", "path").alias("b")).distinct().hint("shuffle_hash")
    inner = cut(_linked(steps).join(into, "b", "left_semi").select(F.col("b").alias("a"), F.col("a").alias("b")), "inner")
    open_bits = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)")).alias("bit")
    first = first.filter("bits is not null")
    starts = first.select(_node("urn", "path").alias("node"), "block", "bits").join(inner.select(F.col("a").alias("node")).hint("shuffle_hash"), "node", "left_semi")
    starts = cut(starts.select("node", "block", open_bits).select("node", (F.col("block") * reach.WORD + F.col("bit")).alias("item")), "starts")
    further, _ = closure.closure(starts.hint("merge"), inner)
    block, bit = F.floor(F.col("item") / reach.WORD).cast("int"), (F.col("item") % reach.WORD).cast("int")
    further = further.select("node.*", block.alias("block"), bit.alias("bit")).select("urn", "path", "block", F.expr("shiftleft(1L, bit)").alias("bits"))
    at_once = seeds.join(bits, "urn").select("urn", "path", "block", "bits")
    every = first.unionByName(further).unionByName(at_once).groupBy("urn", "path", "block").agg(F.bit_or("bits").alias("bits"))
    asked = every.withColumn("node", _node("urn", "path")).join(seeds.select(_node("urn", "path").alias("node")).hint("shuffle_hash"), "node", "left_semi")
    return asked.select("urn", "path", "block", open_bits).join(known, ["block", "bit"]).select("urn", "path", F.col("seed").alias("model_urn"))
