"""Operator 13: Merkle dataset manifest with nested-interval labels.

Every document is a leaf; the leaves of a source, in order of doc_id, are hashed
in runs of three up to the source's subroot, and the subroots, in order of
source, in the same way up to the root of the dataset.

Labels.  A node carries the interval [lo, hi) of the leaf ranks that it covers.
Intervals of one tree are nested: a node is an ancestor of another one exactly if
its interval contains the other's.  Ranks come from one range shuffle by (source,
doc_id): each task numbers its rows, and prefix sums over (task, source) counts
turn task numbers into ranks, so a source with a third of all rows is spread over
tasks like any other.

Levels.  The nodes of a level are one aggregation by interval bucket (lo div
3**level): three digests at most meet.  Each level is a written table with a
third of the rows of the one below.

Proofs.  Ancestors are attached from the top: the nodes of a level join the level
above on (tree, bucket) where the ancestor's interval contains theirs.  The
difference of the parent's interval and the node's own is what its siblings cover:
those that end at or before `lo` stand to the left, those that begin at or after
`hi` to the right.  A node inherits its parent's path, so a path is built once for
all the leaves below it, and the leaves take part in a single join.

Results for odd input: a null field is `-`, unlike an empty one; rows without
doc_id or source are leaves, before the others of their order; rows that repeat a
doc_id are a leaf each, in order of their digests (equal rows are equal leaves);
an empty table has no root and gives no rows; a source of one document has its
leaf as subroot; columns other than those of `FIELDS` are not read, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Stage, partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's values: `-` for null, else UTF-8 byte count, colon and value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


@dataclass
class Tree:
    """Levels of nodes: (tree, n, lo, hi, digest) and from level 1 `children`, the (lo, hi, digest) of the run below.

    tree: which tree; n: its number of leaves.  The last node of a tree is the one of the level where 3**level >= n."""
    levels: list[DataFrame]

    def tops(self, level: int) -> DataFrame:
        return self.levels[level].where(F.col("n") <= ARITY ** level)

    def roots(self) -> DataFrame:
        """(tree, digest): the root of each tree."""
        out = self.tops(0).select("tree", "digest")
        for level in range(1, len(self.levels)):
            out = out.union(self.tops(level).select("tree", "digest"))
        return out


@dataclass
class Manifest:
    """leaves: (tree, n, lo, hi, digest, doc_id and the carried columns); sources: (tree, source, n); root: None if empty."""
    leaves: DataFrame
    sources: DataFrame
    by_source: Tree
    over_sources: Tree
    root: str | None
    stage: Stage = field(repr=False)

    def nodes(self) -> DataFrame:
        """(part, tree, level, lo, hi, digest) of all nodes; part: `source` for the tree of a source, `root` for the one over subroots."""
        out = None
        for part, tree in (("source", self.by_source), ("root", self.over_sources)):
            for level, nodes in enumerate(tree.levels):
                one = nodes.select(F.lit(part).alias("part"), "tree", F.lit(level).alias("level"), "lo", "hi", "digest")
                out = one if out is None else out.union(one)
        return out


def _ranked(leaves: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(leaves with tree, n and rank, one row a source): tree numbers follow the order of sources, ranks that of leaves."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    placed = leaves.repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    placed = stage.keep(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    task = F.shiftrightunsigned("at", 33)
    runs = placed.groupBy(task.alias("task"), "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("source")
    before = own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage.keep(runs.select("*", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(own).alias("n"),
                                  (F.min("task").over(own) == F.col("task")).alias("begins")), "runs")
    # number of a source: sources that begin in earlier tasks (a row a task), then those before it in its own task
    begin = runs.where("begins")
    earlier = begin.groupBy("task").agg(F.count(F.lit(1)).alias("s"))
    earlier = earlier.select("task", (F.sum("s").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("earlier"))
    numbered = begin.withColumn("k", F.row_number().over(Window.partitionBy("task").orderBy("first")) - 1)
    sources = stage.keep(numbered.join(earlier, "task").select((F.col("earlier") + F.col("k")).alias("tree"), "source", "n"), "sources")
    runs = runs.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("task", "first", "before", "tree", "s.n", F.col("r.source").alias("of"))
    found = placed.withColumn("task", task).join(runs, "task").where(F.col("source").eqNullSafe(F.col("of")))
    rank = F.col("before") + F.col("at") - F.col("first")
    ranked = found.select("tree", "n", rank.alias("lo"), (rank + 1).alias("hi"), *[c for c in placed.columns if c not in ("at", "source")])
    return stage.keep(ranked, "leaves"), sources


def _bucket(level: int) -> Column:
    return F.expr(f"lo div {ARITY ** level}L").alias("bucket")


def grow(leaves: DataFrame, stage: Stage, name: str) -> Tree:
    """The tree over (tree, n, lo, hi, digest) leaves, level by level until every tree has one node left."""
    levels, level = [leaves.select("tree", "n", "lo", "hi", "digest")], 0
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while ARITY ** level < largest:
        level += 1
        run = levels[-1].where(F.col("n") > ARITY ** (level - 1)).groupBy("tree", "n", _bucket(level))
        nodes = run.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        nodes = nodes.select("tree", "n", F.get("children", F.lit(0))["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
                             F.sha2(F.concat_ws("", F.col("children.digest")), 256).alias("digest"), "children")
        levels.append(stage.keep(nodes, f"{name}-{level}"))
    return Tree(levels)


def _side(test) -> Column:
    return F.concat_ws("", F.transform(F.filter("a.children", test), lambda c: c["digest"]))


def attach(nodes: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """`nodes` of `level` with the path and carried columns of their parents in `above` (tree, lo, hi, children, path, ...)."""
    carried = [c for c in above.columns if c not in ("tree", "n", "lo", "hi", "digest", "children", "path")]
    n, a = nodes.select("*", _bucket(level + 1)).alias("n"), above.select("*", _bucket(level + 1)).alias("a")
    inside = (F.col("n.tree") == F.col("a.tree")) & (F.col("n.bucket") == F.col("a.bucket")) & (F.col("a.lo") <= F.col("n.lo")) & (F.col("n.hi") <= F.col("a.hi"))
    step = F.struct(_side(lambda c: c["hi"] <= F.col("n.lo")).alias("left"), _side(lambda c: c["lo"] >= F.col("n.hi")).alias("right"))
    return n.join(a, inside).select(*[F.col(f"n.{c}") for c in nodes.columns], F.concat(F.array(step), "a.path").alias("path"), *[F.col(f"a.{c}") for c in carried])


def paths(tree: Tree, leaves: DataFrame, above: DataFrame) -> DataFrame:
    """`leaves` with `path`, the (left, right) digests of the siblings from the leaf's level up, and the columns of `above`.

    above: (tree, path, ...) of each tree's root: what stands above it."""
    def rooted(nodes, level):
        return nodes.where(F.col("n") <= ARITY ** level).join(above, "tree").select(*nodes.columns, "path", *[c for c in above.columns if c not in ("tree", "path")])
    found = None
    for level in range(len(tree.levels) - 1, -1, -1):
        nodes = tree.levels[level] if level else leaves
        here = rooted(nodes, level)
        found = here if found is None else here.unionByName(attach(nodes.where(F.col("n") > ARITY ** level), found, level))
    return found


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`; carry: further columns of the leaves, as expressions over the documents."""
    stage = Stage(docs.sparkSession, "manifest")
    leaves = docs.select("doc_id", "source", leaf_digest(*[F.col(c) for c in FIELDS]).alias("digest"), *[v.alias(k) for k, v in (carry or {}).items()])
    leaves, sources = _ranked(leaves, stage)
    by_source = grow(leaves, stage, "source")
    subroots = by_source.roots()
    count = sources.count()
    subroots = stage.keep(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "digest"), "subroots")
    over = grow(subroots, stage, "root")
    root = over.roots().first()
    return Manifest(leaves, sources, by_source, over, root and root["digest"], stage)


_PATH = "array<struct<left:string,right:string>>"


def proofs(made: Manifest) -> DataFrame:
    """The leaves with `subroot`, `root` and `path`: the siblings' digests from the leaf to the root, as (left, right)."""
    spark = made.leaves.sparkSession
    top = spark.range(1).select(F.col("id").alias("tree"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    subroots = paths(made.over_sources, made.over_sources.levels[0], top).select(F.col("lo").alias("tree"), "path", F.col("digest").alias("subroot"))
    found = paths(made.by_source, made.leaves, made.stage.keep(subroots, "above"))
    return found.withColumn("root", F.lit(made.root).cast("string"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda a, s: digest(s["left"], a, s["right"]))


def path_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def audit(docs: DataFrame, tampered: Column, where: Column) -> DataFrame:
    """Proof and check of every document when its text becomes `tampered` where the condition holds.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf of the new text) and verified."""
    changed = F.when(where, leaf_digest(*[F.col(c) for c in FIELDS[:-1]], tampered))
    found = proofs(manifest(docs, {"changed": changed}))
    folded = found.withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def newline_audit(docs: DataFrame) -> DataFrame:
    """`audit` of texts that lose their line feeds where 2 divides the crc32 of the decimal doc_id."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return audit(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("")), even)
