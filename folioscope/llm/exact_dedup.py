"""Exact deduplication by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.runtime import drop, settled, written

#: Characters of a block.
BLOCK = 16384


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _blocks(text: Column, size: int) -> Column:
    """The text cut into blocks of `size` characters; an empty text has one empty block."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(cut)


def _digest(block: Column) -> list[Column]:
    # A second column is hashed with the first's hash as its seed, so the salt stands first: the two hashes are independent.
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(7), block).alias("h2")]


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with integer names in their sort order: a range sort, then numbers that rise over it."""
    return keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(id, text_sha256, n_blocks, name): equal (n_blocks, name) exactly for equal normalised texts.

    Distinct blocks are grouped by their content, sorted and named by integers; then adjacent
    names are paired and named again, until a document has one. Rows find the name of their
    block by a 128-bit digest, after a check on all distinct blocks that no two of them share
    one; if two did, rows would be joined on the blocks themselves. So names never collide.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    marked = _marked(rows.withColumn("row", F.monotonically_increasing_id()), size)
    # Equal blocks meet on the map side first, so that a block of many rows is sent once per task.
    content = rows.select(F.explode(_blocks(F.col("text"), size)).alias("block")).groupBy("block").agg(F.lit(1).alias("one"))
    counted = content.select(*_digest(F.col("block"))).groupBy("h1", "h2").agg(F.count("*").alias("sharing"))
    names = written(_named(counted, "h1", "h2"), "names")
    if names.filter("sharing > 1").isEmpty():
        flat = marked.select("row", F.size("digests").alias("n_blocks"), F.posexplode("digests").alias("at", "d"))
        level = settled(flat.select("row", "n_blocks", "at", "d.h1", "d.h2").join(names, ["h1", "h2"]).select("row", "n_blocks", "at", "name"), "level", names)
    else:
        # Numbered once more and written with the texts, so that both tables know a row by one number.
        drop(marked)
        drop(names)
        texts = written(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
        marked = _marked(texts, size)
        level = _named_by_content(texts, size)
        drop(texts)
    done = None
    levels = [level]
    while True:
        single = level.filter("n_blocks = 1 or at = -1").select("row", "name")
        done = single if done is None else done.union(single)
        rest = level.filter("n_blocks > 1 and at >= 0")
        if rest.isEmpty():
            break
        level = written(_paired(rest), "level")
        levels.append(level)
    return settled(marked.select("row", "id", "text_sha256", F.size("digests").alias("n_blocks")).join(done, "row"), "identities", marked, *levels)


def _marked(rows: DataFrame, size: int) -> DataFrame:
    digests = F.transform(_blocks(F.col("text"), size), lambda b: F.struct(*_digest(b))).alias("digests")
    return written(rows.select("id", F.sha2("text", 256).alias("text_sha256"), digests, "row"), "blocks")


def _paired(level: DataFrame) -> DataFrame:
    """One level up: names of pairs of adjacent names; at = -1 marks a document with one name left."""
    pairs = level.groupBy("row", "n_blocks", F.expr("at div 2").alias("at")).agg(
        F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
    )
    tall = pairs.withColumn("width", F.max("at").over(_by_row()) + 1)
    names = _named(pairs.select("left", "right").distinct(), "left", "right")
    return tall.join(names, ["left", "right"]).select(
        "row", "n_blocks", F.when(F.col("width") == 1, F.lit(-1)).otherwise(F.col("at")).cast("int").alias("at"), "name"
    )


def _by_row():
    from pyspark.sql import Window

    return Window.partitionBy("row")


def _named_by_content(texts: DataFrame, size: int) -> DataFrame:
    """The first level where two distinct blocks share a digest: rows of (row, text) join names on the blocks themselves."""
    blocks = texts.select("row", _blocks(F.col("text"), size).alias("blocks"))
    flat = blocks.select("row", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("at", "block"))
    names = written(_named(flat.select("block").distinct(), "block"), "names")
    return settled(flat.join(names, "block").select("row", "n_blocks", "at", "name"), "level", names)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, row) for every row of docs.

    Null counts as the empty text. Of equal texts the smallest id stays; a null id is larger
    than any. Of repeated rows with that id, one stays. `group_size` counts rows. Extra columns are ignored.
    """
    named = identities(docs, id_col, text_col, size)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    # Written before the join, so that its two sides are plain shuffles and a group with many rows can be split.
    groups = written(named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    joined = named.join(groups, ["n_blocks", "name"])
    return joined.select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        "row",
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows with a null id stay too, as no id names their copy.

    Repeated rows with the same id and an equal text are one document: one of them stays.
    """
    groups = exact_groups(docs, id_col, text_col)
    keep = groups.filter(F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"))
    digest = F.sha2(normalised(F.col(text_col)), 256)
    named = docs.filter(F.col(id_col).isNotNull())
    repeated = groups.filter(F.col("id").isNotNull()).groupBy("id").count().filter("count > 1")
    if not repeated.isEmpty():
        named = named.withColumn("__text", digest).dropDuplicates([id_col, "__text"]).drop("__text")
    stay = named.join(keep, (F.col(id_col) == F.col("__id")) & (digest == F.col("__sha")), "left_semi")
    return stay.unionByName(docs.filter(F.col(id_col).isNull()))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and kept row of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
  sha256(t) AS text_sha256
FROM n
"""
