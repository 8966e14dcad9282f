"""Near-duplicates from bottom-k sketches.

One hash function orders all shingles. A text's sketch is the k smallest hashes of its shingle set. Texts with equal sets
form one node from the start. Two sets of the wanted similarity share most of their sketches' values, so a node goes on only
if enough of its values are retained by other nodes too. For the nodes that are left, few in a clean corpus, the sketch is
extended to the whole set.

Inverted lists hold each node under the rarest values of its set, as many as a similar node cannot all lack. `left`, the
number of a node's values that come no earlier than the list's own, bounds what two members share if this is the first list
that they share: such bounds on sizes and places rule out almost all pairs of a list within the join. Pairs that pass are
held against the union of their sketches, an estimate, and then against their full sets, which decide.

Large groups of near copies are contracted first: in each list that meets several components every other member is paired
with the most central member of the largest component, that is the one with the fewest values of its own. This costs one
pair for each place in a list. Only members of different components are then paired in full, so no link is lost to that.

The sketches decide which nodes go on and which pairs are worth their full sets. At a similarity of 0.85 the shared part of
a union sketch of 64 has a mean of 54 and a deviation below 3; `margin` deviations less are asked for, so a link right at the
threshold is lost with a probability of about 1e-5. Sets of up to k shingles are compared without that risk. With margin=None
every node goes on and every pair that the bounds allow is compared in full: the result is exact.

Empty and null texts have an empty set, are linked with nothing and are all kept. Texts of any length are taken whole: a
text's set is in the memory of one task. Links at just the threshold count. Of a component one document is kept, that is
one pair of id and text, the one of least id; a repeated row is judged like the first, but of rows without an id only one is
kept. Null ids never name a component unless all its ids are null. Other columns are ignored; no rows give none.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, map_arrow, struct, texts_of

K = 64
MARGIN = 5
REMEMBERED = 200_000
ROUNDS = 3
#: The most nodes whose keys, some 100 bytes each, are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}
        self.factors = [np.uint64(xxhash.xxh3_64_intdigest(f"factor {i}") | 1) for i in range(width)]

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space separates
        if not found:
            return np.empty(0, np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        if len(h) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64).view(np.int64)
        n = len(h) - self.width + 1
        total = np.zeros(n, np.uint64)
        for i, f in enumerate(self.factors):
            part = h[i : i + n]
            total += (part ^ (part >> np.uint64(29))) * f
            total ^= total >> np.uint64(31)
        total *= self.factors[0]
        return np.unique((total ^ (total >> np.uint64(32))).view(np.int64))


def digest(text: Column) -> Column:
    """Tells texts apart where ids do not; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketches(docs: DataFrame, width: int, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_shingles, name (the digest of the whole set, null if empty), sketch."""

    shingler = Shingler(width)  # every task has its own copy

    def run(batch):
        sets = [shingler(t) for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "n_shingles": [len(s) for s in sets], "name": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "sketch": [s[:k] for s in sets]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias("digest"))
    return map_arrow(rows, run, struct(f"doc_id {docs.schema[id_col].dataType.simpleString()}, digest binary, n_shingles long, name binary, sketch array<long>"))


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, members; null where the text's set is not the one that the node is named after."""

    shingler = Shingler(width)  # every task has its own copy

    def run(batch):
        sets = [shingler(t) for t in texts_of(batch)]
        names = batch.column("name").to_pylist()
        return {"node": batch.column("node"), "members": [x if xxhash.xxh3_128_digest(x.tobytes()) == n else None for x, n in zip(sets, names, strict=True)]}

    return map_arrow(texts.select("node", "name", "text"), run, struct("node long, members array<long>"))


def _asked(size: Column, percent: int, margin: float) -> Column:
    """How many values of a union sketch of this size are in both sets, less so many deviations."""
    t = percent / 100
    return size * t - margin * F.sqrt(size * t * (1 - t))


def _going_on(nodes: DataFrame, percent: int, k: int, margin: float | None) -> DataFrame:
    """The nodes that may have a similar one: enough of their sketch's values are in other nodes' sketches.

    Whole sets share `percent` of the larger, less what the larger one's sketch leaves out. Of cut sketches the values that
    the estimate asks for are in both: a value of the union sketch that is in both sets is in both sketches.
    """
    if margin is None:
        return nodes.select("node", "n")
    t = percent / 100
    whole = F.least(F.col("n") * t, F.col("n") - F.greatest(F.col("n") / t - k, F.lit(0.0)))
    need = F.ceil(F.when(F.col("n") <= k, whole).otherwise(_asked(F.lit(float(k)), percent, margin)) - 1e-9)
    values = nodes.select("node", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    found = values.join(shared, "value").groupBy("node", "n").agg(F.count("*").alias("found"))
    return found.where(F.col("found") >= need).select("node", "n")


def inverted(sets: DataFrame, percent: int) -> DataFrame:
    """value, node, n, left, central: every node under the rarest values of its set, as many as a similar node cannot all lack.

    `left` is the number of the node's shared values that come no earlier than this one, the rarest being first; `central`
    is the share of its values that other nodes have.
    """
    values = sets.select("node", F.size("members").alias("n"), F.explode("members").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    per_node = values.join(shared, "value").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    need = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    listed = F.greatest(F.size("found") - need + 1, F.lit(0))
    rows = per_node.select("node", "n", F.size("found").alias("m"), F.posexplode(F.slice("found", F.lit(1), listed)).alias("i", "x"))
    return rows.select("x.value", "node", "n", (F.col("m") - F.col("i")).alias("left"), (F.col("m") / F.col("n")).alias("central"))


def _open(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists that meet several components: each member's root, and in `main` the list's largest component and its centre."""
    placed = lists.withColumn("root", F.col("node")) if roots is None else lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = placed.groupBy("value", "root").agg(F.count("*").alias("c"), F.max(F.struct("central", "node", "n", "left")).alias("top"))
    main = per_root.groupBy("value").agg(F.max(F.struct("c", "top", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("value", "main")
    return placed.join(main, "value")


def _may_share(na: Column, nb: Column, left: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar if they share no more than `left` values."""
    return ((100 + percent) * left >= percent * (na + nb)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _to_centres(open_lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of the main component's centre and each member of another component."""
    others = open_lists.where("root <> main.root")
    near = others.where(_may_share(F.col("n"), F.col("main.top.n"), F.least("left", "main.top.left"), percent))
    return near.select(F.least("node", "main.top.node").alias("a"), F.greatest("node", "main.top.node").alias("b")).distinct()


def _across(open_lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of different components that the bounds allow, one of them outside the main component.

    The smaller set of a pair shares more than half of the threshold's twofold with the larger, so it needs a shorter part of its
    list places; classes of size, one step of the threshold each, are part of the key.
    """
    step = float(np.log(100 / percent))
    size_class = F.floor(F.log("n") / step + 1e-9).cast("int")
    rows = open_lists.select("value", "node", "n", "left", "root", (F.col("root") == F.col("main.root")).alias("in_main"), size_class.alias("size_class"))
    low = rows.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
    low = low.select("value", F.explode(F.array("size_class", F.col("size_class") + 1)).alias("size_class"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("root").alias("ra"), F.col("in_main").alias("ma"))
    high = rows.select("value", "size_class", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("root").alias("rb"), F.col("in_main").alias("mb"))
    fits = (F.col("ra") != F.col("rb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") != F.col("b")))) & _may_share(F.col("na"), F.col("nb"), F.least("la", "lb"), percent)
    outside = low.where("not ma").join(high, ["value", "size_class"]).where(fits)
    inside = low.where("ma").join(high.where("not mb"), ["value", "size_class"]).where(fits)
    return outside.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hopeful(pairs: DataFrame, nodes: DataFrame, percent: int, k: int, margin: float | None) -> DataFrame:
    """Pairs whose union sketch does not rule the similarity out by its share of values in both."""
    if margin is None:
        return pairs
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    df = pairs.join(b, "b").join(a, "a")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return df.where((both >= _asked(F.size(union), percent, margin)) | (F.greatest("na", "nb") <= k)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    df = pairs.join(b, "b").join(a, "a")
    shared = F.size(F.array_intersect("ma", "mb"))
    return df.where(100 * shared >= percent * (F.size("ma") + F.size("mb") - shared)).select("a", "b")


def components(links: DataFrame, stored: Scratch) -> DataFrame:
    """(node, root): alternating large and small stars until the stars stay; root is the least node of the component.

    Every pass is a grouped minimum and a join. Nodes without links are absent.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stored(links.where("a <> b").select(a, b).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, k: int = K, margin: float | None = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: texts linked where 100 * shared >= percent * united shingles."""
    return judged(docs, width, percent, k, margin, id_col, text_col).drop("digest")


def judged(docs: DataFrame, width: int, percent: int, k: int = K, margin: float | None = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_duplicates with the digest of each row's text. The folder that the result reads stays; the others are deleted."""
    stored = Scratch(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(named, width, k).withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "row"))
    nodes = sketched.where("name is not null").groupBy("name").agg(best.alias("best"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))  # a number, half as wide in all that follows as the name
    rows = stored(sketched.drop("sketch"))
    stored.delete_first()

    going = _going_on(nodes, percent, k, margin).select("node")
    chosen = stored(nodes.join(going, "node").select("node", "name", F.col("best.doc_id").alias("c_id"), F.col("best.digest").alias("c_digest")))
    few = chosen.count() <= BROADCAST_ROWS
    own = F.col("doc_id").eqNullSafe(F.col("c_id")) & (digest(F.col("text")) == F.col("c_digest"))
    texts = named.join(F.broadcast(chosen) if few else chosen, own).select("node", "name", "text")
    sets = stored(_full_sets(texts, width).where("members is not null").dropDuplicates(["node"]))
    lists = stored(inverted(sets, percent))

    links = roots = None
    for _ in range(ROUNDS):
        found = stored(_confirmed(_hopeful(_to_centres(_open(lists, roots), percent), nodes, percent, k, margin), sets, percent))
        if found.isEmpty():
            break
        links = found if links is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found)
        roots = components(links, stored)
    more = stored(_confirmed(_hopeful(_across(_open(lists, roots), percent), nodes, percent, k, margin), sets, percent))
    if not more.isEmpty():
        roots = components(more if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), stored)

    named_nodes = nodes.select("name", "node", "best")
    named_nodes = named_nodes if roots is None else named_nodes.join(roots, "node", "left")
    named_nodes = named_nodes.withColumn("root", F.lit(None).cast("long") if roots is None else F.col("root")).withColumn("root", F.coalesce("root", "node"))
    names = named_nodes.groupBy("root").agg(F.min("best").alias("best"))
    ids = named_nodes.drop("best").join(names, "root").select("name", "best")
    out = rows.join(ids, "name", "left")
    # Without words (no best) a row is kept.
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest")) & (F.col("doc_id").isNotNull() | (F.col("row") == F.col("best.row")))
    out = stored(out.select("doc_id", "digest", "n_shingles", F.coalesce("best.doc_id", "doc_id").alias("component_id"), (F.col("best").isNull() | same).alias("kept")))
    stored.delete_all_but_last()
    return out
