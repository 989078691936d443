"""Merkle manifest of a dataset: a tree of hashes for each source and one above them, and a recursive query that climbs it.

*Leaves.* A row's leaf is the hash of its columns, each ``-`` if null, else byte count, colon, value.
Leaves of a source ascend by id; every ``FAN`` consecutive ones become the hash of their digests, and
so on level by level until one is left, the source's subroot. Subroots, by source, are the lowest
level of one more tree, whose top is the root.

*Places.* A source may hold a third of all rows, so no source is sorted in one task: rows are
range-partitioned by source and id and numbered inside their partition, and the few counts of each
partition and source give where its numbering starts.

*Stored levels.* Each level is built from the one below by a group of at most ``FAN`` nodes and is
written to the shared folder, every node with a link to its parent and its place there. The loop
over levels is as long as the tree is high; only one count and one maximum reach the driver.

*Climb.* The leaves of one lowest run share all siblings above it, so a run is one row of the
climb, which folds each of its leaves by itself: Spark's recursive query joins the run to the parent
of the node it has reached, appends that node's siblings once and folds every leaf's hash with them,
until no parent is left. Nodes that many runs pass, above all the root, are stored in copies,
one for each ``PER_COPY`` runs, so that no task takes all runs. A leaf's proof is its siblings
inside the run and the run's list.

Defined cases: a null source is a source of its own, the first; null ids come first in their source
and are never tampered with; a null text is hashed as null and stays; rows that repeat an id are
leaves each, ordered by their leaves; a lone leaf is its source's subroot, and the root too where
there is no other source, with a proof of no siblings; an empty table gives an empty table; a text
of any length is hashed whole; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, shared_folder

#: Nodes that become one node of the next level.
FAN = 16
#: Runs that take the same copy of a stored node.
PER_COPY = 1024
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: The name of the tree above the sources; those of sources are empty or begin with "=".
TOP = "^"


def digest(content: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(content, 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(columns: list[Column]) -> Column:
    """The hash of the columns, each ``-`` or its byte count, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _stored(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Rows with their place, from 0, in their group; however large a group is, no task takes it whole."""
    folder = f"{shared_folder(rows.sparkSession)}/numbered-{uuid.uuid4().hex}"
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # equal rows may be many, and are dealt apart
    ranged = tied.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*by, *order, "_tie"]]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*by, *order]])
    placed = _stored(ranged.drop("_tie").withColumn("_id", F.monotonically_increasing_id()), folder).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part", *by).agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", *by, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low")).alias("_start"))
    return placed.join(starts, ["_part", *by]).withColumn(name, F.col("_id") + F.col("_start")).drop("_id", "_part", "_start")


def _parent(level: Column, several: bool) -> list[Column]:
    """Where the parent of a node stands, and the node's place among its children."""
    inside, top = F.col("n") > 1, (F.col("tree") != TOP) & F.lit(several)
    own = F.when(inside, F.col("idx")).when(top, F.col("tree_idx"))
    return [
        F.when(inside, F.col("tree")).when(top, TOP).alias("up_tree"), F.when(inside, level + 1).when(top, 1).cast("int").alias("up_level"),
        F.floor(own / FAN).alias("up_idx"), F.pmod(own, F.lit(FAN)).cast("int").alias("place"),
    ]


def _next_level(nodes: DataFrame, level: int) -> DataFrame:
    """One node for every run of ``FAN`` nodes (tree, tree_idx, idx, n, runs, hash) of a level."""
    met = nodes.groupBy("tree", "tree_idx", F.floor(F.col("idx") / FAN).alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"), F.ceil(F.first("n") / FAN).cast("long").alias("n"), F.sum("runs").alias("runs"))
    met = met.withColumn("children", F.aggregate("kids", F.lit(b""), lambda a, k: F.concat(a, k["hash"])))
    return met.select("tree", "tree_idx", "idx", "n", "runs", digest(as_hex(F.col("children"))).alias("hash"), "children", F.lit(level).alias("level"))


def _siblings(children: Column, place: Column) -> tuple[Column, Column]:
    """The digests before and after a place."""
    return F.substring(children, F.lit(1), place * 32), F.substring(children, place * 32 + 33, F.octet_length(children))


CLIMB = """
WITH RECURSIVE climb (tree, run, folded, above, subroot, hash, up_tree, up_level, up_idx, place, copies) AS (
  SELECT tree, run, folded, CAST('' AS BINARY), subroot, hash, up_tree, up_level, up_idx, place, copies FROM {runs}
  UNION ALL
  SELECT c.tree, c.run,
    transform(c.folded, f -> unhex(sha2(lower(hex(concat(substring(n.children, 1, c.place * 32), f, substring(n.children, c.place * 32 + 33, 512)))), 256))),
    concat(c.above, substring(n.children, 1, c.place * 32), substring(n.children, c.place * 32 + 33, 512)),
    CASE WHEN n.tree = c.tree THEN n.hash ELSE c.subroot END, n.hash, n.up_tree, n.up_level, n.up_idx, n.place, n.copies
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND pmod(c.run, c.copies) = n.copy
)
SELECT tree, run, folded, above, subroot, hash AS root FROM climb WHERE up_tree IS NULL
"""


def manifest(docs: DataFrame, columns: list[str] = COLUMNS, tampered: Column | None = None, altered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row; the first two columns are id and source.

    Rows where ``tampered`` holds are folded from the leaf that they would have with the ``altered`` columns.
    """
    spark, own = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/merkle-{uuid.uuid4().hex}"
    ident, source = (F.col(f"`{c}`") for c in columns[:2])
    changed = leaf([(altered or {}).get(c, F.col(f"`{c}`")) for c in columns])
    leaves = docs.select(
        ident.alias("doc_id"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string"))).alias("tree"),
        leaf([F.col(f"`{c}`") for c in columns]).alias("leaf"), F.when(F.coalesce(tampered, F.lit(False)), changed).alias("other") if tampered is not None else F.lit(None).cast("binary").alias("other"))
    leaves = numbered(_stored(leaves, f"{own}/leaves"), ["tree"], ["doc_id", "leaf"])  # stored, as the range partitioning reads its input twice

    runs = leaves.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "doc_id", "leaf", "other"))).alias("leaves"))
    runs = _stored(runs.select("tree", "run", F.transform("leaves", lambda s: F.struct(s["doc_id"], s["leaf"], s["other"])).alias("leaves")), f"{own}/runs")
    trees = numbered(runs.groupBy("tree").agg(F.sum(F.size("leaves")).alias("n_leaves")), [], ["tree"], "tree_idx")
    trees = _stored(trees, f"{own}/trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n_leaves"), F.lit(0))).first()

    children = F.aggregate("leaves", F.lit(b""), lambda a, s: F.concat(a, s["leaf"]))
    lone = F.col("n_leaves") == 1
    low = runs.join(trees, "tree").withColumn("children", children).select(
        "tree", "tree_idx", F.col("run").alias("idx"), F.ceil(F.col("n_leaves") / FAN).cast("long").alias("n"), F.lit(1).cast("long").alias("runs"),
        F.when(lone, F.col("children")).otherwise(digest(as_hex(F.col("children")))).alias("hash"))
    low = _stored(low, f"{own}/low")

    def climb_levels(nodes: DataFrame, level: int, most: int) -> DataFrame:
        """Store the levels above ``nodes``, whose largest tree has ``most`` of them; the tops of the trees."""
        tops = nodes.where("n = 1")
        while most > 1:
            level, most = level + 1, -(-most // FAN)
            nodes = _stored(_next_level(nodes.where("n > 1"), level), f"{own}/level-{uuid.uuid4().hex}")
            built.append(nodes)
            tops = tops.unionByName(nodes.where("n = 1").select(*tops.columns))
        return tops

    built: list[DataFrame] = []
    tops = climb_levels(low, 1, -(-most // FAN))
    if n_trees > 1:
        climb_levels(tops.select(F.lit(TOP).alias("tree"), F.lit(0).cast("long").alias("tree_idx"), F.col("tree_idx").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "runs", "hash"), 0, n_trees)
    if not built:
        built = [_next_level(low.where("false"), 1)]
    nodes = built[0]
    for more in built[1:]:
        nodes = nodes.unionByName(more)

    several = n_trees > 1
    copies = F.ceil(F.col("runs") / PER_COPY)
    parents = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), copies.alias("copies"))
    linked = nodes.withColumn("n_copies", copies).select("tree", "level", "idx", "hash", "children", "n_copies", *_parent(F.col("level"), several)).join(parents, ["up_tree", "up_level", "up_idx"], "left")
    linked = _stored(linked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)).alias("copy")).drop("n_copies"), f"{own}/nodes")

    folds = F.transform("leaves", lambda s, k: digest(as_hex(F.concat(_siblings(F.col("children"), k)[0], F.coalesce(s["other"], s["leaf"]), _siblings(F.col("children"), k)[1]))))
    first = runs.withColumn("children", children).join(low.withColumnRenamed("idx", "run"), ["tree", "run"])
    alone = (F.col("n") == 1) & (F.size("leaves") == 1)  # a lone leaf is not hashed again
    first = first.withColumns({"folded": F.when(alone, F.transform("leaves", lambda s: F.coalesce(s["other"], s["leaf"]))).otherwise(folds), "idx": F.col("run")})
    first = first.select("tree", "run", "folded", F.when(F.col("n") == 1, F.col("hash")).alias("subroot"), "hash", *_parent(F.lit(1), several)).join(parents, ["up_tree", "up_level", "up_idx"], "left")
    first = _stored(first, f"{own}/first")

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the climb has a row for every run and level
    try:
        climbed = _stored(spark.sql(CLIMB, runs=first, nodes=linked), f"{own}/climbed")
    finally:
        spark.conf.set(limit, before)

    met = runs.join(climbed, ["tree", "run"]).withColumn("children", children)
    each = met.select("subroot", "root", "above", "children", F.posexplode(F.arrays_zip("leaves", "folded")).alias("k", "s"))
    before_, after = _siblings(F.col("children"), F.col("k"))
    return each.select(
        F.col("s.leaves.doc_id").alias("doc_id"), as_hex(F.col("s.leaves.leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(F.col("root")).alias("root"),
        F.sha2(as_hex(F.concat(before_, after, "above")), 256).alias("proof_sha256"), as_hex(F.col("s.folded")).alias("folded_root"), (F.col("s.folded") == F.col("root")).alias("verified"))


def case_tampered(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest of ``documents``, folded with the text's A-Z lower-cased where the id's CRC-32 is divisible by ``every``."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return manifest(docs, COLUMNS, chosen, {"text": F.translate(F.col("text"), UPPER, LOWER)})
