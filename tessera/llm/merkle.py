"""A Merkle manifest of a dataset, built level by level with sibling-shift self-joins.

Every row is a leaf: the sha256 of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value. Leaves are numbered within their group (one tree
a group) in ascending id; a level is a table ``(tree, idx, size, h)``. Each level
equijoins its nodes with the indices of their siblings (``idx XOR 1`` for binary
trees, slot offsets otherwise), and the rows of slot zero emit the parents. The
roots of the groups, in byte order of the group (null first), are the leaves of one
more tree, built by the same steps.

Going back down, each node's path is its siblings followed by its parent's path,
so a document's proof holds every sibling from its leaf to the root. A proof is
folded from the leaf with the node's index and the tree's size alone; no other row
is needed to verify a document.

Numbering never gathers a group: rows are range-partitioned by group and id,
written to the shared folder, numbered within their partition, and shifted by the
counts of (partition, group), of which there are at most partitions plus groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Bytes of a digest.
DIGEST = 32
#: Rows of (partition, group) counts up to which they are broadcast.
FEW_COUNTS = 50_000


def _text_digest(text: Column) -> Column:
    """Digest, as bytes, of text or bytes."""
    return F.unhex(F.sha2(text, 256))


def _hex(digests: Column) -> Column:
    """Lowercase hex of one digest or of several in a row; null as empty."""
    return F.coalesce(F.lower(F.hex(digests)), F.lit(""))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else byte count, ``:``, value."""
    return _text_digest(F.concat(*(
        F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within ``tree`` by ``order``, and ``size``,
    the rows of the tree. Equal rows get places of their own, in any order."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = rows.withColumn("_m", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(n, tree, *order, "_m").sortWithinPartitions(tree, *order, "_m").drop("_m")
    # the bounds are sampled, so the partitions are fixed before they are read again
    placed = written(placed.withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    counts = written(placed.groupBy("_part", tree).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")))
    group = W.partitionBy(tree)
    starts = counts.select(
        F.col("_part").alias("_p"), F.col(tree).alias("_t"), F.sum("_n").over(group).alias("size"),
        (F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_shift"))
    if counts.count() <= FEW_COUNTS:
        starts = F.broadcast(starts)
    joined = placed.join(starts, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
    return joined.withColumn("idx", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_p", "_t", "_shift")


def _slot(arity: int) -> Column:
    return F.col("idx") % arity


def _with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Nodes of a level with ``sib``, the digests of the others of their run from
    left to right: one equijoin for each shift."""
    other = level.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("h").alias("_h"))
    out = level
    for shift in range(1, arity):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - _slot(arity) + (_slot(arity) + shift) % arity
        mate = other.select("_tree", "_idx", F.col("_h").alias(f"_h{shift}"))
        out = out.join(mate, F.col("tree").eqNullSafe(F.col("_tree")) & (place == F.col("_idx")), "left").drop("_tree", "_idx")
    # the mate of shift d stands in slot (slot + d) % arity: those of slot - arity + d come first
    ordered = [F.coalesce(F.col(f"_h{d}"), F.lit(b"")) for d in range(1, arity)]
    slots = [F.concat(*ordered[arity - 1 - s:], *ordered[: arity - 1 - s]) for s in range(arity)]
    sib = reduce(lambda rest, s: F.when(_slot(arity) == s, slots[s]).otherwise(rest), range(arity - 1), slots[arity - 1])
    return out.withColumn("sib", sib).drop(*(f"_h{d}" for d in range(1, arity)))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """The parents, emitted by the nodes of slot zero."""
    return level.where((_slot(arity) == 0) & (F.col("size") > 1)).select(
        "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
        _text_digest(F.concat(_hex(F.col("h")), _hex(F.col("sib")))).alias("h"))


def build_levels(leaves: DataFrame, arity: int = 2) -> list[DataFrame]:
    """Levels ``(tree, idx, size, h, sib)`` of all trees over ``(tree, idx, size, h)``,
    each in the shared folder; a tree's last level has size 1."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels = [written(_with_siblings(leaves.select("tree", "idx", "size", "h"), arity))]
    while most > 1:
        most = -(-most // arity)
        levels.append(written(_with_siblings(_parents(levels[-1], arity), arity)))
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """``(tree, h)`` of every tree's root."""
    return reduce(DataFrame.unionByName, (level.where("size = 1").select("tree", "h") for level in levels))


def leaf_paths(levels: list[DataFrame], arity: int = 2, above: DataFrame | None = None) -> DataFrame:
    """``(tree, idx, path, more columns of above)`` of the leaves: the digests of
    all siblings up to the tree's root, left to right within a level. ``above``
    has a row of further columns for each tree, passed down from its root."""
    extra = [c for c in above.columns if c != "tree"] if above is not None else []
    paths = None
    for place, level in reversed(list(enumerate(levels))):
        top = level.where("size = 1").select("tree", "idx", F.lit(b"").alias("path"))
        if above is not None:
            own = above.select(F.col("tree").alias("_tree"), *extra)
            top = top.join(own, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if paths is not None:
            up = paths.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), *extra)
            lower = level.where("size > 1").join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.expr(f"idx div {arity}") == F.col("_idx")))
            top = top.unionByName(lower.select("tree", "idx", F.concat("sib", "_path").alias("path"), *extra))
        # one level's joins to a plan
        paths = written(top) if place else top
    return paths


def folded(leaf: str, idx: str, size: str, path: str, arity: int = 2) -> Column:
    """Root digest recomputed from a leaf, its place, the tree's size and its path."""
    state = f"named_struct('h', {leaf}, 'i', {idx}, 'n', {size}, 'at', 1)"
    others = f"least({arity}, s.n - (s.i - s.i % {arity})) - 1"
    part = "substring(" + path + ", s.at + {0}, {1})"
    left = part.format("0", f"int(s.i % {arity}) * {DIGEST}")
    right = part.format(f"int(s.i % {arity}) * {DIGEST}", f"int({others} - s.i % {arity}) * {DIGEST}")
    step = (f"IF(s.n <= 1, s, named_struct('h', unhex(sha2(lower(concat(hex({left}), hex(s.h), hex({right}))), 256)), "
            f"'i', s.i div {arity}, 'n', (s.n + {arity - 1}) div {arity}, 'at', s.at + int({others}) * {DIGEST}))")
    # a tree of n leaves has no more levels than n has binary digits
    return F.expr(f"aggregate(sequence(1, length(bin({size}))), {state}, (s, _level) -> {step}, s -> s.h)")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", count_col: str = "n_chars",
                    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), arity: int = 2,
                    tampered: Column | None = None) -> DataFrame:
    """A row per document: id, ``leaf``, ``subroot`` (of its group's tree), ``root``,
    ``proof_sha256`` (digest of all siblings from leaf to root), ``folded_root``
    (recomputed from the leaf and its proof) and ``verified``.

    Where ``tampered`` (a condition on the input's columns) is true, the root is
    folded from a leaf whose ``count_col`` has 1 added (a null one stays): such
    rows fail verification unless nothing changed.

    Null ids come first within a group; the null group is a tree of its own, first
    among the groups. Rows of equal id are ordered by their leaf, so different
    texts under one id have fixed places, and equal rows are leaves of their own.
    Null and empty texts differ (``-`` and ``0:``). A group of one row has its
    leaf as subroot; an empty table has no rows. Only ``fields`` are hashed; other
    columns, whatever their names, are not read."""
    plain = leaf_digest([F.col(f) for f in fields])
    changed = leaf_digest([F.col(f) + 1 if f == count_col else F.col(f) for f in fields])
    told = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    # the tampered leaf stays null where nothing is tampered with
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("tree"), plain.alias("h"), F.when(told, changed).alias("bad"))
    leaves = written(numbered(leaves, "tree", ["id", "h"]))
    levels = build_levels(leaves, arity)

    tops = numbered(subroots(levels).select(F.lit(0).alias("forest"), F.col("tree").alias("name"), "h"), "forest", ["name"])
    tops = written(tops.select(F.col("forest").alias("tree"), "idx", "size", "h", "name"))
    upper = build_levels(tops, arity)
    root = subroots(upper).select(F.col("h").alias("root"))  # one row
    above = (leaf_paths(upper, arity).withColumnsRenamed({"path": "top_path", "idx": "top_idx", "tree": "_t"})
             .join(tops.withColumnRenamed("size", "top_size"), F.col("top_idx") == F.col("idx"))
             .select(F.col("name").alias("tree"), F.col("h").alias("subroot"), "top_idx", "top_size", "top_path"))
    first = root.first()
    above = written(above.withColumn("root", F.lit(bytes(first[0]) if first else b"")))

    paths = leaf_paths(levels, arity, above).withColumnsRenamed({"tree": "_tree", "idx": "_idx"})
    rows = leaves.join(paths, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("idx") == F.col("_idx")))
    rows = rows.withColumn("start", F.coalesce("bad", "h"))
    rows = rows.withColumn("mid", folded("start", "idx", "size", "path", arity))
    rows = rows.withColumn("end", folded("mid", "top_idx", "top_size", "top_path", arity))
    return rows.select(
        F.col("id").alias(id_col), _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(F.concat(_hex(F.col("path")), _hex(F.col("top_path"))), 256).alias("proof_sha256"),
        _hex(F.col("end")).alias("folded_root"), (F.col("end") == F.col("root")).alias("verified"))


_FIELDS_SQL = " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "{n}", "text"))

#: DuckDB (which has no crc32: a table of 256 entries by recursion) for the binary manifest of documents.
MERKLE_SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b::UBIGINT, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents),
crc(doc_id, s, i, c) AS (
  SELECT doc_id, s, 0, 4294967295::UBIGINT FROM ids
  UNION ALL SELECT doc_id, s, i + 1, xor(c >> 8, t[(xor(c, ascii(s[i + 1])::UBIGINT) & 255)::INT + 1]) FROM crc, crc_table WHERE i < length(s)),
bad AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) % 7 = 0 AS bad FROM crc WHERE i = length(s)),
leaf0 AS (SELECT doc_id, lang, sha256({_FIELDS_SQL.format(n="n_chars")}) AS h, sha256({_FIELDS_SQL.format(n="(n_chars + 1)")}) AS changed FROM documents),
leaf AS MATERIALIZED (SELECT l.doc_id, coalesce('v' || lang, 'n') AS tree, h, CASE WHEN coalesce(bad, false) THEN changed ELSE h END AS told,
  row_number() OVER (PARTITION BY lang ORDER BY l.doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size
  FROM leaf0 l LEFT JOIN bad ON l.doc_id = bad.doc_id),
node(tree, lvl, idx, size, h) AS (
  SELECT tree, 0, idx, size, h FROM leaf
  UNION ALL SELECT tree, lvl + 1, idx // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE size > 1 GROUP BY tree, lvl, idx // 2),
sub AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM node WHERE size = 1),
top(lvl, idx, size, h) AS (
  SELECT 0, idx, size, h FROM sub
  UNION ALL SELECT lvl + 1, idx // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY lvl, idx // 2),
step AS (
  SELECT l.doc_id, l.idx, l.tree, n.lvl AS place, (l.idx >> n.lvl) & 1 AS rightmost, s.h AS sib FROM leaf l JOIN node n ON n.tree = l.tree AND n.idx = l.idx >> n.lvl AND n.size > 1
    LEFT JOIN node s ON s.tree = n.tree AND s.lvl = n.lvl AND s.idx = xor(n.idx, 1)
  UNION ALL SELECT l.doc_id, l.idx, l.tree, 1000 + n.lvl, (b.idx >> n.lvl) & 1, s.h FROM leaf l JOIN sub b ON b.tree = l.tree JOIN top n ON n.idx = b.idx >> n.lvl AND n.size > 1
    LEFT JOIN top s ON s.lvl = n.lvl AND s.idx = xor(n.idx, 1)),
proof AS MATERIALIZED (SELECT tree, idx, list(coalesce(sib, '') ORDER BY place) AS sibs, list(rightmost ORDER BY place) AS sides FROM step GROUP BY tree, idx),
fold(tree, idx, k, h) AS (
  SELECT tree, idx, 0, told FROM leaf
  UNION ALL SELECT f.tree, f.idx, k + 1, sha256(CASE WHEN sides[k + 1] = 1 THEN sibs[k + 1] || h ELSE h || sibs[k + 1] END)
  FROM fold f JOIN proof p ON p.tree = f.tree AND p.idx = f.idx WHERE k < len(sibs))
SELECT l.doc_id, l.h AS leaf, b.h AS subroot, r.h AS root, sha256(coalesce(array_to_string(p.sibs, ''), '')) AS proof_sha256,
  f.h AS folded_root, f.h = r.h AS verified
FROM leaf l JOIN sub b ON b.tree = l.tree CROSS JOIN (SELECT h FROM top WHERE size = 1) r
LEFT JOIN proof p ON p.tree = l.tree AND p.idx = l.idx
JOIN fold f ON f.tree = l.tree AND f.idx = l.idx AND f.k = coalesce(len(p.sibs), 0)
"""
