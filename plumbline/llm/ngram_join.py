"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed SHINGLE-word n-grams; equal sets are one class from the start. Of each set
a signature of SAMPLES sampled tokens is kept (minima under as many hashes). A run of the join splits
all sets recursively: a node of the recursion samples positions that its path hasn't had, and each set goes on
with its own tokens at them, so similar sets share paths. Of a pair at the threshold, whose signatures agree MARGIN
deviations less than expected, one sampled position agrees on average; a family of sets that agree in half their positions
or fewer so takes ever fewer paths the deeper it goes. Buckets up to SMALL sets are compared by brute force; larger ones give off what is near their leader and split on. Runs repeat until a pair
at the threshold meets with probability TARGET_RECALL: the deeper the buckets that sets were in, the more runs they take part in,
RUNS_AT_ONCE at a time.

Sets whose signatures agree by LOOSE or more are candidates; a bucket passes on only a forest of
them, not its pairs. In a large bucket a set within CLOSE of the leader is done, as by the triangle
inequality all its own partners are within LOOSE of that leader, and so is a bucket without sets
beyond LOOSE. The components of the candidates hold every link. Each component's exact sets then
meet in pairs of blocks, which count the links of each set and pass on forests again; classes
are the components of those. A block has BLOCK sets and BLOCK_BYTES bytes at most; a component of more than one block is
split into levels of size first, a factor of 1 / threshold apart, as linked sets are of one level or of two neighbouring
ones. Pairs are never emitted; links are counted exactly.

Defined results: texts without words link to nothing; texts of fewer words than SHINGLE have one
n-gram; very long texts are sets like others; a similarity of exactly the threshold links; equal sets are one class
whatever their identifiers; repeated rows are rows of their own; a null identifier comes after all others; ``keep_one``
carries other columns under any names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, materialize, plainly
from plumbline.llm.exact_dedup import flagged, hit_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
SAMPLES = 64
#: Standard deviations of the agreement of a pair at the threshold: wider means more paths and fewer runs.
MARGIN = 1.5
RUNS_AT_ONCE = 4
SMALL = 4096
BLOCK = 4096
BLOCK_BYTES = 16 << 20
LOOSE = 0.5
CLOSE = 0.88
#: N-grams hashed at a time.
STEP = 1 << 13
CACHE_WORDS = 100_000


def branching(threshold: float, level):
    """Positions that a node at a level samples on average."""
    agreeing = threshold * SAMPLES - MARGIN * math.sqrt(SAMPLES * threshold * (1 - threshold))
    return (SAMPLES - level) / np.maximum(agreeing - level, 1)


def survival(agreeing: int, threshold: float, depth: int) -> float:
    """Probability that two sets whose signatures agree in so many positions share a path of ``depth`` levels in one run."""
    q = 1.0
    for level in reversed(range(depth)):
        met = q * max(agreeing - level, 0) / (SAMPLES - level)
        whole, more = divmod(float(branching(threshold, level)), 1)
        q = 1 - (1 - met) ** whole * (1 - more * met)
    return q


@functools.cache
def runs_needed(threshold: float, target: float, depth: int) -> int:
    """Runs after which a pair at the threshold has shared a path of ``depth`` levels with probability ``target``.

    The positions in which such a pair agrees are binomial.
    """
    chance = [math.comb(SAMPLES, k) * threshold**k * (1 - threshold) ** (SAMPLES - k) for k in range(SAMPLES + 1)]
    misses = [1 - survival(k, threshold, depth) for k in range(SAMPLES + 1)]
    runs = 1
    while sum(c * m**runs for c, m in zip(chance, misses)) > 1 - target:
        runs += 1
    return runs


#: Levels after which all sets of a bucket agree in LOOSE of their positions, so that none goes on.
DEEPEST = math.ceil(LOOSE * SAMPLES)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(SHINGLE)]


def shingles_of(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text, A-Z lower-cased."""
    words = WORD.findall((text or "").translate(UPPER)) if text and not text.islower() else WORD.findall(text or "")
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = []
    for w in words:
        h = cache.get(w)
        if h is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            h = cache[w] = xxhash.xxh3_64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _POWERS[i]
    return np.unique(_mixed(total))


_HASHES = np.random.default_rng(5).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_of(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES 16-bit marks of the smallest n-gram under each hash."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), STEP):
        least = np.minimum(least, (shingles[at : at + STEP, None] * _HASHES).min(axis=0))
    return (_mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(docs: DataFrame) -> DataFrame:
    """A written table, a row per row of ``docs``: doc_id, text_key, n, set_key, sig."""

    def run(batches):
        cache: dict = {}
        for b in batches:
            n, keys, sigs = [], [], []
            for x in b.column("text"):
                s = shingles_of(x.as_py(), cache)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(signature_of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_key", "n", "set_key", "sig"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return materialize(keyed.mapInArrow(run, "doc_id long, text_key long, n int, set_key binary, sig binary"), "sketches")


def representatives(sketches: DataFrame) -> DataFrame:
    """A row per distinct non-empty set: node, set_key, rep_doc, n, sig, as a written table."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    reps = sketches.filter("n > 0").groupBy("set_key").agg(F.min(order)["doc_id"].alias("rep_doc"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    return materialize(reps.withColumn("node", F.monotonically_increasing_id()), "sets")


def _positions(keys: np.ndarray, used: np.ndarray, branch: int) -> np.ndarray:
    """The position that each node of the recursion samples for a branch, none of those in its bitmap ``used``."""
    at, left, draw = np.zeros(len(keys), dtype=np.uint64), np.arange(len(keys)), 0
    while len(left):
        at[left] = _mixed(keys[left] + np.uint64(draw * 0xD1B5 + branch * 0x9E37 + 1)) % np.uint64(SAMPLES)
        left, draw = left[(used[left] >> at[left]) & np.uint64(1) == 1], draw + 1
    return at


def deeper(keys: np.ndarray, used: np.ndarray, sigs: np.ndarray, threshold: float):
    """Paths one level deeper, as (rows, keys, used) per branch: the key, the branch and the own token there."""
    coin = (_mixed(keys + np.uint64(0x5851F42D)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    branches = np.floor(branching(threshold, np.bitwise_count(used).astype(np.float64)) + coin).astype(np.int64)
    tried = used.copy()
    for branch in range(int(branches.max(initial=0))):
        rows = np.flatnonzero(branches > branch)
        at = _positions(keys[rows], tried[rows], branch)
        mark = np.uint64(1) << at
        tried[rows] |= mark
        token = sigs[rows, at.astype(np.int64)].astype(np.uint64)
        yield rows, _mixed(keys[rows] ^ _mixed(token + np.uint64((branch + 1) << 20))), used[rows] | mark


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SAMPLES)


def descend(frontier: DataFrame, threshold: float) -> DataFrame:
    """(path, used, node) one level below a frontier (path, used, node, sig); ``used`` is a bitmap of the path's positions."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, used = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("path", "used"))
            for rows, paths, marks in deeper(keys, used, _signatures(b.column("sig")), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(marks.view(np.int64)), b.column("node").take(pa.array(rows))], names=["path", "used", "node"])

    return frontier.select("path", "used", "node", "sig").mapInArrow(run, "path long, used long, node long")


def shared_paths(paths: DataFrame) -> DataFrame:
    """The rows of buckets with two sets or more, with the bucket's size and leader; a written table."""
    paths = materialize(paths, "paths")
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1")
    return materialize(paths.join(sizes, "path"), "buckets")


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def brute_force(sigs: np.ndarray) -> list[tuple[int, int]]:
    """Candidate links among a small bucket's sets, a forest: leaders against those left."""
    parent = list(range(len(sigs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, links = np.arange(len(sigs)), []
    while len(left) > 1:
        leader, rest = left[0], left[1:]
        near = agreement(sigs[rest], sigs[leader])
        for i in rest[near >= LOOSE].tolist():
            a, b = root(int(leader)), root(i)
            if a != b:
                parent[b] = a
                links.append((int(leader), i))
        left = rest[near < CLOSE]
    return links


def compare_small(members: DataFrame) -> DataFrame:
    """Candidate links (a, b) in buckets of SMALL sets at most: rows (path, node, sig)."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []

        def links():
            if len(held) > 1:
                sigs = np.frombuffer(b"".join(s for _, _, s in held), dtype=np.uint16).reshape(-1, SAMPLES)
                for i, j in brute_force(sigs):
                    yield min(held[i][1], held[j][1]), max(held[i][1], held[j][1])

        for b in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "node", "sig"))):
                if held and held[0][0] != row[0]:
                    found.extend(links())
                    held = []
                held.append(row)
            yield pair_batch(found)
        yield pair_batch(list(links()))

    ordered = members.select("path", "node", "sig").repartition("path").sortWithinPartitions("path", "node")
    return ordered.mapInArrow(run, "a long, b long")


def pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def compare_leaders(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Large buckets' members against their leaders: path, used, node, sig, leader, near; a written table."""

    held = ("path", "used", "node", "sig", "leader")

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = agreement(_signatures(b.column("sig")), _signatures(b.column("leader_sig")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in held), pa.array(near)], names=[*held, "near"])

    leaders = sets.select(F.col("node").alias("leader"), F.col("sig").alias("leader_sig"))
    led = members.filter(F.col("node") != F.col("leader")).join(sets.select("node", "sig"), "node").join(leaders, "leader")
    return materialize(led.select(*held, "leader_sig").mapInArrow(run, "path long, used long, node long, sig binary, leader long, near double"), "led")


def walk(frontier: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate links (a, b) of a frontier's runs, and the sets (node, depth) that went on below each level."""
    found, went = None, []
    while True:
        buckets = shared_paths(descend(frontier, threshold))
        small = buckets.filter(F.col("size") <= SMALL).join(sets.select("node", "sig"), "node")
        links = compare_small(small)
        large = buckets.filter(F.col("size") > SMALL)
        more = large.limit(1).count() > 0
        if more:
            led = compare_leaders(large, sets)
            near = led.filter(F.col("near") >= LOOSE)
            links = links.unionByName(near.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")))
            mixed = led.filter(F.col("near") < LOOSE).select("path").distinct()
            frontier = led.filter(F.col("near") < CLOSE).join(mixed, "path", "left_semi")
            went.append(frontier.select("node", F.lit(len(went) + 2).alias("depth")))
        found = links if found is None else found.unionByName(links)
        if not more:
            return found, went


def candidates(sets: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """Candidate links (a, b), a below b, of all runs of the recursion; a written table.

    A pair that meets in no run so far shared a large bucket or no path at all. So after the runs for one level only sets of
    large buckets go on, each as often as its depth asks for: no pair shares deeper buckets than either of its sets was in.
    """
    needed = F.array(*(F.lit(runs_needed(threshold, target, depth)) for depth in range(1, DEEPEST + 1)))
    entering, first, found = sets.select("node", "sig", F.lit(1).alias("depth")), 0, None
    while True:
        runs = F.least(F.element_at(needed, F.least("depth", F.lit(DEEPEST))), F.lit(first + RUNS_AT_ONCE))
        roots = F.transform(F.sequence(F.lit(first), runs - 1), lambda r: r.cast("long") * 7919 + 17)
        frontier = entering.select("node", "sig", F.lit(0).cast("long").alias("used"), F.explode(roots).alias("path"))
        links, went = walk(frontier, sets, threshold)
        links = materialize(links.distinct(), "candidates")
        found, first = links if found is None else found.unionByName(links), first + RUNS_AT_ONCE
        deep = functools.reduce(DataFrame.unionByName, went, entering.filter("depth > 1").select("node", "depth"))
        deep = deep.groupBy("node").agg(F.max("depth").alias("depth")).filter(F.element_at(needed, F.least("depth", F.lit(DEEPEST))) > first)
        if not went and first == RUNS_AT_ONCE:
            return found
        entering = materialize(deep.join(sets.select("node", "sig"), "node").select("node", "sig", "depth"), "entering")
        if not entering.limit(1).count():
            return materialize(found.distinct(), "candidates")


def exact_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (set_key, rep_doc and more) with the column shingles, from a second scan of the texts.

    Other texts are turned away by a filter on the identifier before any shuffle. A set whose
    representative is there twice comes twice.
    """
    table, bits = hit_filter(wanted.select(F.coalesce("rep_doc", F.lit(-1)).alias("digest")), wanted.count(), 64)

    def run(batches):
        cache: dict = {}
        for b in batches:
            sets = [shingles_of(x.as_py(), cache) for x in b.column("text")]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "key", "shingles"]
            )

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("digest"), "text")
    texts = flagged(texts, "digest", table, bits, "hit").filter("hit").select("digest", "text").mapInArrow(run, "id long, key binary, shingles binary")
    same = (F.col("key") == F.col("set_key")) & (F.col("id") == F.coalesce("rep_doc", F.lit(-1)))
    return texts.join(wanted, same).drop("id", "key")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component; a written table.

    Alternates two contractions, to the smallest neighbour of all and of the smaller ones, until
    the links form stars.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select("b", F.col("m"))).filter("a <> b").distinct()
        small = materialize(small.select("a", "b"), "stars")
        # Done when every node points to one root and no root points on.
        looks = small.groupBy("a").count().filter("count > 1").limit(1).count() or small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        edges = small
        if not looks:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), "roots")


def count_links(sets: list[np.ndarray], other: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of every set in two blocks, and a forest of them.

    The second block starts at ``other``; pairs count across the blocks, or within the one block if
    ``other`` is 0. Intersections come from an inverted index of the sets' n-grams.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(token, kind="stable")
    holders, begin = owner[by], np.searchsorted(token[by], np.arange(int(token.max()) + 2))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    degree, parent, forest = np.zeros(n, dtype=np.int64), list(range(n)), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(other or n):
        own = token[starts[i] : starts[i + 1]]
        low, high = begin[own], begin[own + 1]
        met = holders[np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(int((high - low).sum()))]
        both = np.bincount(met, minlength=n)
        linked = both >= threshold * (sizes + sizes[i] - both) - 1e-9
        linked[: other or i + 1] = False
        for j in np.flatnonzero(linked).tolist():
            degree[i] += 1
            degree[j] += 1
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                forest.append((i, j))
    return degree, forest


def blocked(sets: DataFrame, loose: DataFrame, threshold: float) -> DataFrame:
    """(node, root, level, side, cross, x, y, set_key, rep_doc): the pairs of blocks that each set of a component goes to.

    ``cross`` pairs are of a block of ``level`` (side 0) and one of the level above it (side 1); all others are within
    a level.
    """
    sized = loose.join(sets.select("node", "set_key", "rep_doc", "n"), "node")
    blocks = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    # A little more than the factor, so that rounding never puts a pair at the threshold two levels apart.
    level = F.floor(F.log("n") / (math.log(1 / threshold) * (1 + 1e-9))).cast("int")
    sized = sized.join(sized.groupBy("root").agg(blocks().alias("whole")), "root").withColumn("level", F.when(F.col("whole") > 1, level).otherwise(0))
    per = sized.groupBy("root", "level").agg(blocks().alias("blocks")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("levels"))
    placed = sized.join(per, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("levels")[F.col("level")]).cast("int"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda k: k < F.coalesce(n, F.lit(0)))
    entry = lambda level, side, cross, x, y: F.struct(level.alias("at"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"), F.lit(cross).alias("cross"), x.alias("x"), y.alias("y"))
    own, block = F.col("level"), F.col("block")
    within = F.transform(upto(F.col("levels")[own]), lambda k: entry(own, (block > k).cast("int"), False, F.least(k, block), F.greatest(k, block)))
    above = F.transform(upto(F.try_element_at("levels", own + 1)), lambda k: entry(own, 0, True, block, k))
    below = F.transform(upto(F.try_element_at("levels", own - 1)), lambda k: entry(own - 1, 1, True, k, block))
    return placed.select("root", "node", "set_key", "rep_doc", F.concat(within, above, below).alias("pairs"))


def exact_links(docs: DataFrame, sets: DataFrame, loose: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n): verified links a < b of each component's forests, and with b null the links n of a.

    ``loose``: (node, root) of the candidates' components. Every set goes to the pairs of blocks that
    its block is in: one for components of a block.
    """
    wanted = materialize(blocked(sets, loose, threshold), "wanted")
    rows = exact_sets(docs, wanted).select("root", "node", "shingles", F.inline("pairs"))
    key = ["root", "at", "cross", "x", "y"]

    def run(batches):
        held: list[tuple] = []

        def compared():
            if len(held) < 2:
                return
            other, nodes = 0, [r[6] for r in held]
            if held[0][2] or held[0][3] != held[0][4]:
                other = sum(r[5] == 0 for r in held)
                if other in (0, len(held)):
                    return
            degree, forest = count_links([np.frombuffer(r[7], dtype=np.uint64) for r in held], other, threshold)
            for i, j in forest:
                yield min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), 0
            for i in np.flatnonzero(degree).tolist():
                yield nodes[i], None, int(degree[i])

        def batch(found):
            a, b, n = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

        for b in batches:
            found: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in (*key, "side", "node", "shingles"))):
                if held and held[0][:5] != row[:5]:
                    found.extend(compared())
                    held = []
                if not held or held[-1][6] != row[6]:
                    held.append(row)
            yield batch(found)
        yield batch(list(compared()))

    ordered = rows.repartition(*key).sortWithinPartitions(*key, "side", "node")
    return materialize(ordered.select(*key, "side", "node", "shingles").mapInArrow(run, "a long, b long, n long"), "links")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_key, class_id, n_links, class_size.

    ``class_id`` is the smallest identifier of the class; ``n_links`` counts the other sets
    that the row's own set is linked to.
    """
    sketches = sketch(docs)
    sets = representatives(sketches)
    tried = candidates(sets, threshold)
    links = exact_links(docs, sets, components(tried), threshold)
    tight = components(links.filter("b is not null"))
    degree = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    grouped = sets.select("node", "set_key", "rep_doc").join(tight, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("rep_doc").isNull(), "rep_doc"))["rep_doc"]
    heads = grouped.groupBy("root").agg(first.alias("class_id"))
    placed = grouped.join(heads, "root").join(degree, "node", "left").select("set_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = sketches.select("doc_id", "text_key", "n", "set_key").join(placed, "set_key", "left")
    lone = F.col("n") == 0
    return named.select(
        "doc_id",
        "text_key",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        lone.alias("lone"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest identifier; all columns kept."""
    return _kept(plainly(docs, "doc_id", "text"), threshold).toDF(*docs.columns)


def _kept(docs: DataFrame, threshold: float) -> DataFrame:
    named = materialize(classes(docs, threshold).filter("not lone"), "classes")
    sizes = named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    sizes = sizes.select(F.col("class_id").alias("sized_class"))
    grouped = materialize(named.join(sizes, F.col("class_id").eqNullSafe(F.col("sized_class")), "left_semi"), "grouped")
    stays = grouped.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("doc_id").alias("own_id"), F.min("text_key").alias("own_key"))
    table, bits = hit_filter(grouped.select(F.coalesce("doc_id", F.lit(-1)).alias("digest")), grouped.count())
    key, text_key, flag, own_id, own_key = fresh(docs, "id_key_", "text_key_", "hit_", "own_id_", "own_key_")
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(text_key, F.xxhash64("text"))
    marked = flagged(marked, key, table, bits, flag)
    maybe = marked.filter(F.col(flag))
    same = lambda x, y: (F.col(key) == F.coalesce(F.col(x), F.lit(-1))) & (F.col(text_key) == F.col(y))
    members = grouped.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    apart = maybe.join(members, same(own_id, own_key), "left_anti")
    chosen = stays.select(F.col("own_id").alias(own_id), F.col("own_key").alias(own_key))
    kept = maybe.join(chosen, same(own_id, own_key)).dropDuplicates([own_id, own_key])
    return marked.filter(~F.col(flag)).select(docs.columns).unionByName(apart.select(docs.columns)).unionByName(kept.select(docs.columns))
