"""Sharding by extendible hashing, in DataFrame functions only.

A document's bucket is a prefix of its hash bits. The directory starts with the
whole table in one bucket; a bucket of more bytes than the limit splits on one
more bit, all others keep their prefix. Because a bucket's bytes can only fall
with each split, a document's shard is its shortest prefix within the limit, so
all splits follow from one histogram of bytes by long prefix. Only buckets that
are still too large at that depth are counted again with longer prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

#: Hash bits at hand; 52 keeps the prefix exact in any engine.
HASH_BITS = 52
#: Further bits in each counting pass over what is still too large.
STEP_BITS = 8


def hash_bits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The first 52 bits of an md5 over id and text, so that different rows with one id can split."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.md5(text_col), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: str | Column, depth: str | Column) -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    depth = F.col(depth) if isinstance(depth, str) else depth
    return F.call_function("shiftright", bits, (F.lit(HASH_BITS) - depth).cast("int"))


def _directory(rows: DataFrame, limit: int) -> DataFrame:
    """Shards as (leaf_depth, leaf, depth): the bucket of a leaf prefix ends at ``depth`` bits."""
    low, found, open_rows, most = 0, None, rows, STEP_BITS
    while True:
        leaves = open_rows.groupBy(_prefix("bits", F.lit(most)).alias("leaf")).agg(F.sum("n_bytes").alias("b"))
        nodes = leaves.select("leaf", "b", F.explode(F.sequence(F.lit(low), F.lit(most))).alias("depth")) \
            .groupBy("depth", F.call_function("shiftright", F.col("leaf"), F.lit(most) - F.col("depth")).alias("node")).agg(F.sum("b").alias("b"))
        nodes = nodes.where((F.col("b") <= limit) | (F.col("depth") == HASH_BITS))
        paths = leaves.select("leaf", F.explode(F.sequence(F.lit(low), F.lit(most))).alias("depth")) \
            .withColumn("node", F.call_function("shiftright", F.col("leaf"), F.lit(most) - F.col("depth")))
        shards = checkpointed(paths.join(nodes, ["depth", "node"]).groupBy("leaf").agg(F.min("depth").alias("depth"))
                              .select(F.lit(most).alias("leaf_depth"), "leaf", "depth"))
        found = shards if found is None else found.union(shards)
        over = checkpointed(leaves.join(shards, "leaf", "left_anti").select(F.col("leaf").alias("over")))
        if most >= HASH_BITS or over.isEmpty():
            return found
        open_rows = open_rows.join(over, _prefix("bits", F.lit(most)) == F.col("over"), "left_semi")
        low, most = most, min(HASH_BITS, most + STEP_BITS)


def _assigned(docs: DataFrame, limit_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, bits, n_bytes, depth, shard`` of each row."""
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), hash_bits(id_col, text_col).alias("bits"),
                                    F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")))
    directory = _directory(rows, limit_bytes)
    depths = [r[0] for r in directory.select("leaf_depth").distinct().orderBy("leaf_depth").collect()]  # at most 7
    assigned = rows.withColumn("depth", F.lit(None).cast("int"))
    for d in depths:
        leaf = directory.where(F.col("leaf_depth") == d).select(F.col("leaf").alias("_leaf"), F.col("depth").alias("_depth"))
        assigned = assigned.join(leaf, _prefix("bits", F.lit(d)) == F.col("_leaf"), "left") \
            .withColumn("depth", F.coalesce("depth", "_depth")).drop("_leaf", "_depth")
    return assigned.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.lpad(F.bin(_prefix("bits", "depth")), F.col("depth"), F.lit("0"))))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, shard, depth, shard_bytes``;
    ``shard`` is the bucket's hash prefix in 0s and 1s (empty: never split).

    - no shard holds more than ``limit_bytes`` of text, except one row that is
      larger by itself, or rows equal in id and text: 52 bits cannot part these,
      so they keep one shard of full depth;
    - null or empty text counts 0 bytes; a null id takes part like any other;
    - an empty table gives an empty result; other columns are ignored.
    """
    named = _assigned(docs, limit_bytes, id_col, text_col)
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return named.join(sizes, "shard").select("doc_id", "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` with one folder per shard, every row once.

    Rows find their shard by their hash bits, of which it is a prefix, so null
    and repeated ids stay one row for one. The folder's column is ``shard``,
    with underscores added if ``docs`` has a column of that name; all columns
    are kept. An empty table gives a folder without shards.
    """
    taken = {c.lower() for c in docs.columns}
    name, bits = "shard", "bits"
    while name in taken:
        name += "_"
    while bits in taken or bits == name:
        bits += "_"
    plan = _assigned(docs, limit_bytes, id_col, text_col).select(F.col("bits").alias(bits), F.col("shard").alias(name)).distinct()
    out = docs.withColumn(bits, hash_bits(id_col, text_col)).join(plan, bits).drop(bits)
    out.repartition(name).write.mode("overwrite").partitionBy(name).parquet(path)


#: Bytes of text in a shard of the registered query.
SHARD_LIMIT = 1 << 20

SHARDING_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 13))::BIGINT AS bits
  FROM documents),
depths AS (SELECT unnest(generate_series(0, {HASH_BITS}))::INTEGER AS depth),
nodes AS (
  SELECT depth, bits >> ({HASH_BITS} - depth) AS node, sum(n_bytes)::BIGINT AS b
  FROM rows, depths GROUP BY ALL HAVING sum(n_bytes) <= {SHARD_LIMIT} OR depth = {HASH_BITS}),
best AS (
  SELECT r.doc_id, r.bits, r.n_bytes, min(n.depth) AS depth
  FROM rows r, nodes n WHERE n.node = r.bits >> ({HASH_BITS} - n.depth) GROUP BY ALL),
named AS (
  SELECT doc_id, n_bytes, depth::BIGINT AS depth, bits,
         CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bits >> ({HASH_BITS} - depth)), depth, '0') END AS shard FROM best)
SELECT doc_id, n_bytes, shard, depth, (sum(n_bytes) OVER (PARTITION BY shard))::BIGINT AS shard_bytes FROM named
"""
