"""A Merkle manifest of a dataset, and the climb that checks every row of it.

Rows are leaves of a tree for each value of a column; the roots of these are the leaves of one more
tree. Each level is built by grouping the one below, so only digests move. Built levels stand in a
table of runs: a run is what one node was hashed from, and each run names the run that its node is in.
A recursive query of Spark climbs these links from every leaf at once: a step joins each leaf's run,
appends the digests of its other nodes to the leaf's proof, and folds the leaf's own digest into the next.

High runs are on the way of very many leaves. A tree is therefore cut into blocks of neighbouring
leaves, and runs above a block are repeated for it, so no key of the join has more leaves than a block.

Digests are kept as 32 bytes; where they are hashed they are lower-case hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import unused
from spanwright.operators.ranking import numbered
from spanwright.operators.skew import even_join
from spanwright.session import Tables

#: Nodes of a run, and levels below a block: FAN ** BLOCK leaves share the runs above them.
FAN, BLOCK = 8, 4
IN_BLOCK = FAN**BLOCK
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Spark stops recursive queries at a depth and at a number of rows; a climb has all rows of the table.
LIMITS = {"spark.sql.cteRecursionLevelLimit": "100", "spark.sql.cteRecursionRowLimit": "-1"}

#: A row for each leaf and step: what the leaf's digest folds to so far, and the siblings that this step appends.
CLIMB = """
with recursive climb as (
  select 0 as step, id, node, tree0, block, pos0, up_tree, up_level, up_pos, slot, changed as folded, cast(null as binary) as siblings, cast(null as binary) as subroot from {leaves}
  union all
  select step+1, null, null, c.tree0, c.block, c.pos0, r.up_tree, r.up_level, r.up_pos, r.slot,
    unhex(sha2(cast(lower(concat(hex(substring(members, 1, 32*c.slot)), hex(folded), hex(substring(members, 32*c.slot+33)))) as binary), 256)),
    concat(substring(members, 1, 32*c.slot), substring(members, 32*c.slot+33)),
    case when r.tree='' and r.level=1 then substring(members, 32*c.slot+1, 32) end
  from climb c join {runs} r on r.tree0=c.tree0 and r.block=c.block and r.tree=c.up_tree and r.level=c.up_level and r.pos=c.up_pos)
select max(id) as id, max(node) as node, max_by(folded, step) as folded, max(subroot) as subroot,
  aggregate(array_sort(collect_list(case when step>0 then struct(step, siblings) end)), cast('' as binary), (proof, x) -> concat(proof, x.siblings)) as proof
from climb group by tree0, pos0"""


def digest(hashed: Column) -> Column:
    """The 32 bytes of SHA-256 of a text."""
    return F.unhex(F.sha2(hashed.cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as ``-`` if null, else the number of its UTF-8 bytes, a colon and its text."""
    text = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A to Z lower-cased where 3 divides the id's crc32; null ids and texts stay as they are."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


@dataclass
class Manifest:
    """``leaves``: a row for each row of the dataset with its digest and the run it is in; ``runs``: built levels; ``root``: hex, None of no rows."""

    leaves: DataFrame
    runs: DataFrame | None
    root: str | None


def _up(over: Column, n: Column, level: Column, pos: Column, top_pos: Column, top: str | None) -> list[Column]:
    """Tree, level and place of the run that a node is in, and the node's place there; a tree's root is in a run of the top tree, if that has any."""
    inner = n > 1
    at = F.when(inner, pos).otherwise(top_pos)
    return [
        F.when(inner, over).otherwise(F.lit(top).cast("string")).alias("up_tree"), F.when(inner, level + 1).otherwise(F.lit(1)).alias("up_level"),
        F.floor(at / FAN).alias("up_pos"), (at % FAN).cast("int").alias("slot"),
    ]


def _levels(kept: Tables, level: DataFrame, most: int) -> list[DataFrame]:
    """The levels above nodes ``tree, pos, node, n, top_pos, blocks`` (``n``: nodes of the tree's level), with ``members``, what each node was hashed from."""
    out: list[DataFrame] = []
    while most > 1:
        most = -(-most // FAN)
        nodes = F.array_sort(F.collect_list(F.struct("pos", "node")))  # FAN at most
        members = F.aggregate(nodes, F.lit(b""), lambda acc, x: F.concat(acc, x["node"])).alias("members")
        runs = level.where(F.col("n") > 1).groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(members, *(F.first(c).alias(c) for c in ("n", "top_pos", "blocks")))
        level = kept.keep(runs.withColumns({"node": digest(hex_text(F.col("members"))), "n": F.ceil(F.col("n") / FAN)}))
        out.append(level)
    return out


def build(leaves: DataFrame, by: str, order: list[str]) -> Manifest:
    """The manifest of ``leaves``, which have ``id``, ``node`` (a row's digest) and ``changed`` (the digest that a climb folds).

    A tree for each value of ``by``, null first, then by UTF-8 bytes; leaves ascend by ``order``, null
    first, equal ones by digests, so repeated rows are leaves of their own. One value may hold all rows:
    leaves are numbered in ranges, and levels grouped by runs. The driver takes two numbers and the root.
    """
    kept = Tables(leaves.sparkSession)
    # A mark before the value, so that null has a key and comes first; '' is the tree above all
    named = kept.keep(leaves.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("tree"), *order, *(c for c in ("id", "node", "changed") if c not in order)))
    placed = kept.keep(numbered(named, ["tree"], [*order, "node", "changed"], "place", kept).select("tree", "id", "node", "changed", (F.col("place") - 1).alias("pos")))
    trees = placed.groupBy("tree").agg(F.count("*").alias("n"))
    trees = kept.keep(numbered(trees, [], ["tree"], "place", kept).select("tree", "n", (F.col("place") - 1).alias("top_pos"), (F.floor((F.col("n") - 1) / IN_BLOCK) + 1).alias("blocks")))
    most, n_trees = trees.agg(F.max("n"), F.count("*")).first()
    if not n_trees:
        return Manifest(placed, None, None)
    each = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = kept.keep(placed.withColumn("block", F.floor(F.col("pos") / IN_BLOCK)).join(each, ["tree", "block"]))
    levels = _levels(kept, placed, most)
    roots = placed.where(F.col("n") == 1).select("tree", "node")
    for r in levels:
        roots = roots.unionByName(r.where(F.col("n") == 1).select("tree", "node"))
    none = F.lit(0).cast("bigint")
    top = trees.join(roots, "tree").select(F.lit("").alias("tree"), F.col("top_pos").alias("pos"), "node", F.lit(n_trees).cast("bigint").alias("n"), none.alias("top_pos"), none.alias("blocks"))
    top = kept.keep(top)
    tops = _levels(kept, top, n_trees)
    root = (tops[-1] if tops else top).select(hex_text(F.col("node")).alias("root")).first().root

    above = "" if tops else None
    col = F.col
    runs = []
    for level, r in enumerate(levels, 1):
        if level <= BLOCK:
            block = F.floor(col("pos") / FAN ** (BLOCK - level))
        else:
            first, end = (F.lit(FAN ** (level - BLOCK)) * (col("pos") + i) for i in (0, 1))
            block = F.explode(F.sequence(first, F.least(end, col("blocks")) - 1))
        up = _up(col("tree"), col("n"), F.lit(level), col("pos"), col("top_pos"), above)
        runs.append(r.select(col("tree").alias("tree0"), block.alias("block"), "tree", F.lit(level).alias("level"), "pos", "members", *up))
    heads = kept.keep(trees.select(col("tree").alias("tree0"), "top_pos", "blocks")) if tops else trees
    for level, r in enumerate(tops, 1):
        own = r.select("pos", "members", "n")
        on = even_join(heads.withColumn("pos", F.floor(col("top_pos") / FAN**level)), own, ["pos"])
        up = _up(F.lit(""), col("n"), F.lit(level), col("pos"), none, None)
        runs.append(on.select("tree0", F.explode(F.sequence(F.lit(0), col("blocks") - 1)).alias("block"), F.lit("").alias("tree"), F.lit(level).alias("level"), "pos", "members", *up))
    links = placed.select("id", "node", "changed", col("tree").alias("tree0"), col("pos").alias("pos0"), "block", *_up(col("tree"), col("n"), F.lit(0), col("pos"), col("top_pos"), above))
    if not runs:
        return Manifest(links, None, root)
    joined = runs[0]
    for r in runs[1:]:
        joined = joined.unionByName(r)
    return Manifest(links, kept.keep(joined), root)


def climbed(manifest: Manifest) -> DataFrame:
    """``id, node, folded, proof, subroot`` of every leaf: the digest that its ``changed`` one folds to, and its siblings' digests on the way.

    Steps of a leaf are rows of the recursion, put together at its end, so that a proof moves once.
    """
    spark = manifest.leaves.sparkSession
    if manifest.runs is None:  # a single row is its own root
        return manifest.leaves.select("id", "node", F.col("changed").alias("folded"), F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    for name, value in LIMITS.items():
        spark.conf.set(name, value)
    return spark.sql(CLIMB, leaves=manifest.leaves, runs=manifest.runs)


def audited(docs: DataFrame) -> DataFrame:
    """Each document's leaf, its tree's and the whole root, the digest of its proof, and whether its tampered text still folds to the root.

    A row for each row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. A tree for
    each ``lang``. Null values, ids too, are hashed as ``-``, null ids come first and are not tampered
    with; empty texts have 0 bytes; repeated rows are leaves of their own; an empty table has no rows;
    other columns are not hashed, whatever their names. Tables of the manifest are kept in the shared folder.
    """
    f = F.col
    id = unused("id", ["lang", "doc_id", "node", "changed"])
    fields = [f("doc_id"), f("source"), f("lang"), f("n_chars")]
    leaves = docs.select(f("doc_id").alias(id), "lang", leaf(*fields, f("text")).alias("node"), leaf(*fields, tampered(f("doc_id"), f("text"))).alias("changed"))
    manifest = build(leaves, "lang", [id])
    out = climbed(manifest)
    root = F.lit(manifest.root).cast("string")
    folded = hex_text(f("folded"))
    return out.select(
        f("id").alias("doc_id"), hex_text(f("node")).alias("leaf"), F.coalesce(hex_text(f("subroot")), root).alias("subroot"), root.alias("root"),
        F.sha2(hex_text(f("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )
