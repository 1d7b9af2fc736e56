"""Mixing sources to target weights (operator 7).

A source's documents, in a fixed pseudorandom order, are one run of words, cut into blocks of fixed
length. The slots that a source gets are dealt over the output shards by a multinomial draw, first over
groups of shards and then within each; slot numbers pass through the source's own pseudorandom permutation, one for each epoch, to block
numbers; and documents meet the drawn blocks in a join on the block's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.storage import saved, small

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 512
#: Slots of a shard on average, and shards that one task deals out.
SHARD_SLOTS, GROUP_SHARDS = 4096, 16
#: Buckets of the fixed order: so many, or more where one would hold more documents; a task sorts a source's part of one.
BUCKETS, BUCKET_ROWS = 1024, 50_000
#: Sources that one task puts in order.
PART_SOURCES = 50_000
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
_ROUNDS = 6


def _round_keys(seed: int, source: int, epoch: int) -> list[np.uint64]:
    return [np.uint64(x) for x in np.random.SeedSequence([seed, int(source) % 2**64, int(epoch)]).generate_state(_ROUNDS, np.uint64)]


def _scramble(x: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & mask


def permuted(index: np.ndarray, n: int, keys: list[np.uint64], back: bool = False) -> np.ndarray:
    """A permutation of 0 .. n - 1 applied to index (or undone): a Feistel network on the least even
    number of bits that holds n, applied again to what falls outside."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        if back:
            for key in reversed(keys):
                left, right = right ^ _scramble(left, key, mask), left
        else:
            for key in keys:
                left, right = right, left ^ _scramble(right, key, mask)
        return (left << shift) | right

    out = once(np.asarray(index, np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _with_running(rows: DataFrame, keys: list[Column], **sums: Column) -> DataFrame:
    """rows with sums over all rows that come before in the order of keys, which tells rows apart. Ranges of
    PART_SOURCES rows are summed up by themselves; what meets in one task is a row for each range."""
    n = max(1, -(-rows.count() // PART_SOURCES))
    rows = rows.withColumns(sums)
    if n == 1:
        within = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return saved(rows.withColumns({c: F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}))
    rows = saved(rows.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("range").agg(*[F.sum(c).alias(c) for c in sums])
    starts = starts.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"start_{c}") for c in sums])
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({c: F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(small(starts), "range")
    return saved(out.withColumns({c: F.col(c) + F.col(f"start_{c}") for c in sums}).drop("range", *[f"start_{c}" for c in sums]))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. A target is its weight times a
    common level, at most MOST_EPOCHS times the source's size; the level is the one at which all
    targets make up the share: sources stop in the order of size to weight. All sums are of whole numbers,
    so that they don't depend on how sources are dealt to tasks.
    """
    by_name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    rows = _with_running(sizes, by_name, place=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST_EPOCHS)).drop("place")
    total = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    by_stop = [F.col("most") / F.col("weight"), F.col("weight"), *by_name]
    rows = _with_running(rows, by_stop, stopped=F.col("most"), closed=F.col("weight"))
    level = (share * (total["words"] or 0) - F.col("stopped")) / (F.lit(total["weight"] or 0.0) - F.col("closed"))
    first = F.min(F.when(F.col("most") >= level * F.col("weight"), F.struct(F.col("most") / F.col("weight"), level.alias("level"))))
    found = rows.agg(first["level"].alias("level")).first()["level"]
    target = F.col("most") if found is None else F.least(F.col("most"), F.lit(found) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _generator(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([int(x) % 2**64 for x in seed]))


def _drawn(block: int, seed: int):
    """Tasks' work on sources: slots of each group of shards, those of each shard, and the blocks behind slots.
    The last two are one step, as two in a task would take two Python processes."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each source's slots, dealt over the groups."""
        for batch in batches:
            for s in batch.itertuples():
                blocks = -(-s.source_size // block)
                epochs, rest = divmod(int(s.target), s.source_size)
                last = s.source_size - (blocks - 1) * block
                touched = 0
                if rest:
                    at = int(permuted(np.array([blocks - 1]), blocks, _round_keys(seed, s.code, epochs), back=True)[0])
                    touched = -(-rest // block)
                    if at < touched and at * block + last + (touched - at - 1) * block < rest:
                        touched += 1
                slots = epochs * blocks + touched
                shards = np.full(-(-s.n_shards // GROUP_SHARDS), GROUP_SHARDS)
                shards[-1] = s.n_shards - GROUP_SHARDS * (len(shards) - 1)
                counts = _generator(seed, s.code).multinomial(slots, shards / s.n_shards)
                used = np.flatnonzero(counts)
                first = np.cumsum(counts)[used] - counts[used]
                yield pd.DataFrame({"code": s.code, "source_size": s.source_size, "words": int(s.target), "part": used, "shards": shards[used], "first": first, "n": counts[used]})

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each group's slots, dealt over its shards: a frame for each shard."""
        for batch in batches:
            for g in batch.itertuples():
                counts = _generator(seed, g.code, g.part).multinomial(g.n, np.full(g.shards, 1 / g.shards))
                used = np.flatnonzero(counts)
                first = g.first + np.cumsum(counts)[used] - counts[used]
                for shard, start, n in zip((g.part * GROUP_SHARDS + used).tolist(), first.tolist(), counts[used].tolist()):
                    yield pd.DataFrame({"code": g.code, "source_size": g.source_size, "words": g.words, "shard": shard, "slot": np.arange(start, start + n)})

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each slot's block, and how many of its words the slot takes."""
        for batch in batches:
            for (code, size, words), part in batch.groupby(["code", "source_size", "words"]):
                n = -(-size // block)
                last = size - (n - 1) * block
                epochs, rest = divmod(words, size)
                slot = part["slot"].to_numpy()
                for epoch in np.unique(slot // n):
                    keys = _round_keys(seed, code, int(epoch))
                    index = slot[slot // n == epoch] % n
                    number = permuted(index, n, keys)
                    length = np.where(number == n - 1, last, block)
                    take = length
                    if epoch == epochs:
                        at = int(permuted(np.array([n - 1]), n, keys, back=True)[0])
                        take = np.clip(rest - (index * block - (at < index) * (block - last)), 0, length)
                    yield pd.DataFrame({"code": code, "block": number, "take": take})

    return groups, shards, blocks_of, lambda batches: blocks_of(shards(batches))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of docs.

    Null and empty texts have size 0 and nothing taken; null is a source of its own; repeated rows
    are documents of their own. The draw depends on doc_id, sizes and seed only, so reruns agree;
    documents that tie in the order have the same id and size, and so exchange their shares only.
    A text of any length is one document over many blocks. Other columns of docs are not read.
    Words taken from a source are its target, rounded down: its last slot may be a short one.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.withColumn("code", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))))
    rows = saved(rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed))))
    rows = rows.withColumn("bucket", F.pmod("order", F.lit(max(BUCKETS, -(-rows.count() // BUCKET_ROWS)))))
    buckets = saved(rows.groupBy("source", "code", "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = buckets.groupBy("source", "code").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"))
    targets = saved(targets.withColumn("code", F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))))

    groups, _, _, blocks_of_groups = _drawn(block_words, seed)
    slots = (targets.agg(F.sum("target")).first()[0] or 0.0) / block_words
    n_shards = int(max(1, -(-slots // shard_slots)))
    sized = targets.where("source_size > 0 AND target >= 1").select("code", "source_size", "target", F.lit(n_shards).alias("n_shards"))
    dealt = sized.mapInPandas(groups, "code long, source_size long, words long, part long, shards long, first long, n long")
    # Few bytes but all the slots: a stated number of partitions, which Spark leaves as it is.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = dealt.repartition(spread, "code", "part").mapInPandas(blocks_of_groups, "code long, block long, take long").where("take > 0")

    in_order = Window.partitionBy("code", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("code", "bucket", F.coalesce(F.sum("bucket_size").over(by_bucket), F.lit(0)).alias("start"))
    placed = rows.where("size > 0").withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    placed = placed.join(starts, ["code", "bucket"]).withColumn("at", F.col("start") + F.col("before"))
    block = F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")))
    pieces = placed.select("code", "source", "doc_id", "size", "at", block.alias("block"))
    low = F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    words = F.greatest(F.lit(0), F.least(high, F.coalesce("take", F.lit(0))) - low)
    taken = (
        pieces.join(drawn.hint("merge"), ["code", "block"], "left")  # grows with the input: Spark must not broadcast it
        .groupBy("code", "source", "at", "doc_id", "size")
        .agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"))
        .select("code", "source", "doc_id", "size", "taken")
    )
    nothing = rows.where("size = 0").select("code", "source", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return (
        taken.unionByName(nothing)
        .join(small(targets.select("code", "source_size", "target")), "code")
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
