"""Exact dedup by deterministic block naming.

Texts are cut into blocks of ``block`` bytes. The distinct blocks are sorted, in the total order (hash, bytes),
and each gets an integer name: its bucket of that order and its rank inside. Adjacent names are then paired,
the distinct pairs are sorted and named likewise, and so on, until every document has one name. Two texts get the
same (number of levels, name) exactly if they are equal: nothing rests on a hash being free of collisions.

The text is shuffled once, to find the distinct blocks, with map-side combining of copies. Names come back to the
documents by the block's 64-bit hash; blocks that share a hash are found in that one shuffle, and only these are
compared by content (``_with_collisions``). Ranks depend on the data alone, not on partition numbers, so a
recomputed task gives the same names. Joins on hot names are split by AQE, and all groups are aggregates
with map-side combining; no list is collected for a group of copies.

Defined cases: a null text counts as empty, and empty texts are equal; of equal texts the row with the largest id
stays (null ids come last); where that row is repeated, one of its copies stays; an empty table gives an empty
result. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.llm.common import cut, text_of

BUCKET_BITS, RANK_BITS = 20, 43
HOT_GROUPS = 50_000


def _names(distinct: DataFrame, hashed: Column, order: list[str]) -> DataFrame:
    """``distinct`` with __name: bucket of the hash, then rank inside the sorted bucket."""
    bucket = F.shiftrightunsigned(hashed, 64 - BUCKET_BITS)
    named = distinct.withColumn("__bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return named.withColumn("__name", F.shiftleft(F.col("__bucket"), RANK_BITS) + rank.cast("long")).drop("__bucket")


def _with_collisions(blocks: DataFrame, names: DataFrame, broadcast_blocks: int) -> DataFrame:
    """blocks with the names of their content; by hash alone where no other block has that hash."""
    shared = names.filter("__bytes is not null")
    collisions = shared.count()
    alone = names.filter("__bytes is null").select("__hash", F.col("__name"))
    if not collisions:
        return blocks.drop("__bytes").join(alone, "__hash")
    shared = shared.select("__hash", "__bytes", F.col("__name").alias("__exact"))
    if collisions <= broadcast_blocks:
        shared = F.broadcast(shared)
    exact = blocks.join(shared, ["__hash", "__bytes"], "left").drop("__bytes")
    named = exact.join(alone, "__hash", "left")
    return named.withColumn("__name", F.coalesce("__exact", "__name")).drop("__exact")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, hashed=F.xxhash64, broadcast_blocks: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``hashed`` is the block hash; any function will do, a poor one only makes more blocks be compared by content.
    """
    text = text_of(text_col)
    base = docs.select(
        F.col(id_col).alias("__id"), F.unhex(F.sha2(text, 256)).alias("__sha"), F.encode(text, "UTF-8").alias("__all")
    )
    count = F.greatest(F.lit(1), F.ceil(F.length("__all") / F.lit(block)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("__all"), i * block + 1, F.lit(block)))
    blocks = (
        base.withColumn("__count", count)
        .select("__id", "__sha", "__count", F.posexplode(pieces).alias("__pos", "__bytes"))
        .withColumn("__hash", hashed("__bytes"))
    )
    found = (
        blocks.groupBy("__hash")
        .agg(F.sort_array(F.collect_set("__bytes")).alias("__set"))
        .select("__hash", F.posexplode("__set").alias("__rank", "__bytes"), F.size("__set").alias("__many"))
        .select("__hash", "__rank", F.when(F.col("__many") > 1, F.col("__bytes")).alias("__bytes"))
    )
    names = cut(_names(found, F.col("__hash"), ["__hash", "__rank"]), "block-names")
    named = _with_collisions(blocks, names, broadcast_blocks).select("__id", "__sha", "__count", "__pos", "__name")
    single = named.filter("__count = 1").select("__id", "__sha", F.lit(0).alias("__levels"), "__name")
    rest = cut(named.filter("__count > 1"), "block-sequences")
    most = rest.agg(F.max("__count")).first()[0] or 1
    level, done = 0, single
    while most > 1:
        level += 1
        half = F.shiftright(F.col("__pos"), 1)
        odd = (F.col("__pos") % 2) == 1
        pairs = rest.groupBy("__id", "__sha", "__count", half.alias("__half")).agg(
            F.max(F.when(~odd, F.col("__name"))).alias("__left"),
            F.coalesce(F.max(F.when(odd, F.col("__name"))), F.lit(-1)).alias("__right"),
        )
        both = ["__left", "__right"]
        named_pairs = _names(pairs.select(*both).distinct(), F.xxhash64(*both), both)
        rest = pairs.join(named_pairs, both).select(
            "__id", "__sha", F.ceil(F.col("__count") / 2).cast("int").alias("__count"), F.col("__half").alias("__pos"), "__name"
        )
        rest = cut(rest, "pair-names")
        done = done.unionByName(rest.filter("__count = 1").select("__id", "__sha", F.lit(level).alias("__levels"), "__name"))
        rest = rest.filter("__count > 1")
        most = -(-most // 2)
    # Of repeated rows (same id, same text) the long ones have become one: count them from the input.
    name = done.groupBy("__id", "__sha").agg(F.max(F.struct("__levels", "__name")).alias("__identity"), F.count("*").alias("__rows"))
    if level:
        copies = base.filter(count > 1).groupBy("__id", "__sha").agg(F.count("*").alias("__copies"))
        same = F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__sha") == F.col("r.__sha"))
        name = name.alias("l").join(copies.alias("r"), same, "left").select(
            "l.__id", "l.__sha", "__identity", F.coalesce("__copies", "__rows").alias("__rows")
        )
    name = cut(name, "identities")
    groups = cut(name.groupBy("__identity").agg(F.max("__id").alias("__keep"), F.sum("__rows").alias("__size")), "identity-groups")
    # Rows of the largest groups, of which there are at most HOT_GROUPS, find theirs without being dealt by it.
    hot = F.col("__size") >= max(64, -(-(groups.agg(F.sum("__size")).first()[0] or 0) // HOT_GROUPS))
    marked = name.join(F.broadcast(groups.filter(hot)), "__identity", "left")
    other = marked.filter("__size is null").drop("__keep", "__size").join(groups.filter(~hot), "__identity")
    out = marked.filter("__size is not null").unionByName(other).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1)).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
