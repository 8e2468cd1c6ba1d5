"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

A row's number (its place in the order of doc_id and text checksum) goes through a keyed permutation of [0, n). Shard and
slot are the remainder and the quotient of the result, so both can be computed from a row number alone, and a row number from
a shard and slot. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.base import query, saved, table

SHARDS, SEED = 40, 20240607
ROUNDS = 8
PRIME = (1 << 31) - 1
#: More walks than this have a chance below n * 2**-WALKS, as each ends with one half at least; then the job fails.
WALKS = 128


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multipliers and offsets of each round, from a linear congruential sequence that starts at the seed."""
    out, x = [], seed % PRIME or 1
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = x * 48271 % PRIME
            key.append(x)
        out.append(tuple(key))
    return out


def domain_bits(n: int) -> tuple[int, int]:
    """Widths of both halves; 2**(sum) is at least n and below 2n where n > 2."""
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def _noise(half: Column, key: tuple[int, int, int], width: int) -> Column:
    a, b, c = (F.lit(k).cast("long") for k in key)
    v = (half * a + b) % F.lit(PRIME)
    return F.shiftright((v * v + c) % F.lit(PRIME), 3).bitwiseAND(F.lit((1 << width) - 1))


def _step(key: tuple[int, int, int], width: int, inverse: bool):
    if inverse:
        return lambda s: F.struct(s.r.bitwiseXOR(_noise(s.l, key, width)).alias("l"), s.l.alias("r"))
    return lambda s: F.struct(s.r.alias("l"), s.l.bitwiseXOR(_noise(s.r, key, width)).alias("r"))


def _rounds(number: Column, n: int, seed: int, inverse: bool) -> Column:
    """One pass of the network over the whole power-of-two domain, as nested single-element transforms."""
    wide, narrow = domain_bits(n)
    # forward: (left, right) -> (right, left ^ noise(right)); the widths swap each round and are back after an even number
    pair = F.array(F.struct(F.shiftright(number, narrow).alias("l"), number.bitwiseAND(F.lit((1 << narrow) - 1)).alias("r")))
    for i in range(ROUNDS)[::-1 if inverse else 1]:
        pair = F.transform(pair, _step(round_keys(seed)[i], wide if i % 2 == 0 else narrow, inverse))
    out = pair[0]
    return F.shiftleft(out.l, narrow).bitwiseOR(out.r)


def permuted(number: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The permutation of [0, n) (or its inverse): walk the cycle until the value is below n again."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        _rounds(number.cast("long"), n, seed, inverse),
        lambda x, _: F.when(x < F.lit(n), x).otherwise(_rounds(x, n, seed, inverse)),
    )
    return F.when(walk < F.lit(n), walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def place(number: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    p = permuted(number, n, seed)
    return (p % F.lit(shards)).cast("int"), F.floor(p / F.lit(shards)).cast("long")


def row_number_of(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """Row number that lies at a shard and slot."""
    return permuted(slot.cast("long") * F.lit(shards) + shard, n, seed, inverse=True)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``row``: gapless numbers from 0 in the given order, by range partitions and their running sizes.

    Rows equal in all order columns get numbers in any order; a scattered tie-break keeps a frequent key from filling one partition.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    spread = df.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    spread = saved(spread.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the table, whatever its size
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_first"))
    row = F.col("_first") + F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return spread.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn("row", row).drop("_part", "_id", "_first")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every row of ``docs(doc_id, text)``: ``doc_id, size, text_crc32, row, shard, slot``.

    Law ``rows``: the shards' counts are at most one apart, slots are gapless from 0. size: UTF-8 bytes plus 16; a null text has size
    16 and checksum 0 like an empty one. Null and repeated doc_ids are rows like others (nulls come first). Equal texts are not
    kept together. Other columns are ignored; an empty table gives an empty result.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = numbered(docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32")),
                    "doc_id", "text_crc32", "size")
    n = rows.count()
    shard, slot = place(F.col("row"), max(n, 1), shards, seed)
    return rows.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"), slot.alias("slot"))


@query("op9_feistel_sharding")
def op9(spark, sf_dir):
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
