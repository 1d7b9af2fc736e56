"""Near-duplicate groups by HyperMinHash (operator 5).

1. Texts with equal shingle sets collapse to one representative, the row with the smallest id.
2. Each representative gets HyperMinHash registers: per bucket, of the smallest hash the count of
   leading zeros (6 bits) and the next 10 bits. Sets of under SMALL shingles let each shingle compete
   in every bucket, under a hash of its own; larger ones deal their shingles out over the buckets.
   Sets near that size get both kinds, so that any two sets that may be linked share one kind.
3. Bands of consecutive registers are hashed. Two sets with the wanted similarity miss each other in
   all bands with a probability below 1e-8 (see ``band_rows``).
4. Pairs of a band: in bands of up to MOST_IN_BAND sets all of them. In larger bands, an exact way
   that doesn't list pairs: shingles that only one set of all those bands has bound each set's
   possible overlap, sets that can't reach the threshold with anything go, the most central set of
   each band is compared with all others, and only sets which that leaves apart are joined with the
   rest, on the rarest shingles of each (one of which linked sets must share) and within the bounds
   that the shared shingle's place sets.
5. Pairs are dropped if the collision-corrected estimate from the registers is over DEVIATIONS standard
   deviations below the threshold (linked pairs are so with a probability below 1e-8), and confirmed on
   the full sets of 64-bit shingle hashes.
6. Components of confirmed links by repeated smallest-label steps with shortcuts, on tables only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import kernels
from weftline.llm.storage import BROADCAST_IDS, arrow_batches, dropped, numbered, saved, small

REGISTERS = 160
SMALL = 320
SHINGLE_WORDS = 5
MOST_IN_BAND = 48
MANTISSA_BITS = 10
#: Pairs that one copy of a set's shingles serves when pairs are confirmed.
PAIRS_PER_COPY = 64
DEVIATIONS = 7
#: Rows with whole texts or sets that Python is handed at once.
BATCH_ROWS = 1000
#: A group of equal sets is hot if it has over one in so many of all rows (and over HOT_ROWS).
HOT_SHARE, HOT_ROWS = 50_000, 1000

_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_ODD = kernels.mix(_SEEDS) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_rows(percent: int) -> int:
    """Registers in a band for a threshold in percent: the most for which missing all bands has a
    probability under 1e-8."""
    for rows in range(8, 1, -1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) < 1e-8:
            return rows
    return 1


def compressed(smallest: np.ndarray) -> np.ndarray:
    """Registers of 64-bit minima: leading zeros and the bits after the first one, 16 bits in all.
    An empty bucket is 0xFFFF."""
    high = np.frexp(smallest.astype(np.float64))[1]  # position of the first one; rounding up is the same for equal minima
    zeros = np.clip(64 - high, 0, 62).astype(np.uint64)
    bits = (smallest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA_BITS)
    out = (zeros << np.uint64(MANTISSA_BITS)) | bits
    return np.where(smallest == _NONE, np.uint64(0xFFFF), out).astype(np.uint16)


def registers_small(shingles: np.ndarray) -> np.ndarray:
    """Every shingle competes in every bucket."""
    x = (shingles[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return compressed(x.min(1))


def registers_large(shingles: np.ndarray) -> np.ndarray:
    """Each shingle competes in the bucket that its hash deals it to."""
    value = kernels.mix(shingles ^ np.uint64(0xA24BAED4963EE407))
    bucket = (kernels.mix(value) % np.uint64(REGISTERS)).astype(np.int64)
    smallest = np.full(REGISTERS, _NONE, np.uint64)
    np.minimum.at(smallest, bucket, value)
    return compressed(smallest)


def band_keys(registers: np.ndarray, rows: int, kind: int) -> list[np.ndarray]:
    """Keys of the bands of each row of registers, but for bands that are all empty."""
    n = registers.shape[1] // rows
    bands = registers[:, : n * rows].reshape(len(registers), n, rows)
    keys = np.broadcast_to(kernels.mix(np.arange(n, dtype=np.uint64) + np.uint64(1 + kind * 4096)), bands.shape[:2])
    for j in range(rows):
        keys = kernels.mix(keys * np.uint64(31) + bands[:, :, j])
    filled = (bands != 0xFFFF).any(2)
    return [k[f].view(np.int64) for k, f in zip(keys, filled, strict=True)]


def _sketches(k: int, percent: int):
    """Task's work on batches (id, text): set size, fingerprint, registers and bands of each text."""
    rows = band_rows(percent)
    both_from = SMALL * percent // 100

    def kind_of(sets: list[np.ndarray], kind: int, bands: list[list[np.ndarray]]) -> list[bytes | None]:
        take = [i for i, s in enumerate(sets) if (0 < len(s) < SMALL if kind == 0 else len(s) >= both_from)]
        out: list[bytes | None] = [None] * len(sets)
        if take:
            made = np.stack([(registers_large if kind else registers_small)(sets[i]) for i in take])
            for i, r, keys in zip(take, made, band_keys(made, rows, kind), strict=True):
                out[i] = r.tobytes()
                bands[i].append(keys)
        return out

    def fingerprint(s: np.ndarray, seed: np.uint64) -> int | None:
        return int(kernels.mix(s ^ seed).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, stop, texts in kernels.parts(batch, 1):
                sets = kernels.shingle_sets(texts, k)
                bands: list[list[np.ndarray]] = [[] for _ in sets]
                small, large = kind_of(sets, 0, bands), kind_of(sets, 1, bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, stop - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s, np.uint64(0)) for s in sets], pa.int64()),
                        pa.array([fingerprint(s, _SEEDS[0]) for s in sets], pa.int64()),
                        pa.array(small, pa.binary()),
                        pa.array(large, pa.binary()),
                        pa.array([np.concatenate(b) if b else None for b in bands], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "set_a", "set_b", "small", "large", "bands"],
                )

    return run


def may_be_linked(p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected estimates from rows of registers come near enough to the threshold."""
    used = ((p != 0xFFFF) | (q != 0xFFFF)).sum(1)
    share = ((p == q) & (p != 0xFFFF)).sum(1) / np.maximum(used, 1)
    # Two different minima agree if their leading zeros (1 in 3) and their mantissas do.
    chance = 1 / 3 / (1 << MANTISSA_BITS)
    least = percent / 100
    return (share - chance) / (1 - chance) >= least - DEVIATIONS * np.sqrt(least * (1 - least) / np.maximum(used, 1))


@F.pandas_udf(T.BooleanType())
def _likely(a_small: pd.Series, a_large: pd.Series, b_small: pd.Series, b_large: pd.Series, percent: pd.Series) -> pd.Series:
    """may_be_linked() of registers of either common kind."""
    out = np.zeros(len(percent), bool)
    for x, y in ((a_small, b_small), (a_large, b_large)):
        at = np.flatnonzero((x.notna() & y.notna()).to_numpy())
        for i in range(0, len(at), 4096):
            rows = at[i : i + 4096]
            p, q = (np.frombuffer(b"".join(z.iloc[rows]), np.uint16).reshape(len(rows), -1) for z in (x, y))
            out[rows] |= may_be_linked(p, q, int(percent.iloc[0]))
    return pd.Series(out)


@F.pandas_udf(T.BooleanType())
def _linked(a: pd.Series, b: pd.Series, percent: pd.Series) -> pd.Series:
    """Whether two sets, as sorted 64-bit hashes, have the similarity."""
    out = []
    for x, y, least in zip(a, b, percent, strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.sort(np.concatenate((p, q)))
        common = int((both[1:] == both[:-1]).sum())
        out.append(100 * common >= least * (len(both) - common))
    return pd.Series(out, dtype=bool)


def _sets(k: int):
    @F.pandas_udf(T.BinaryType())
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([s.tobytes() for a, b in kernels.blocks(texts) for s in kernels.shingle_sets(texts[a:b], k)], dtype=object)

    return sets


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for each id in an edge.

    Each round takes the smallest label of an id and its neighbours and then that label's own label,
    so that the rounds grow with the logarithm of the longest path; every round is a written table.
    """
    links = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        step = saved(step)
        above = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        # A label may be a hub's id, shared by a large component: Spark splits such partitions.
        after = saved(step.join(above, "component").select("id", F.least("component", "top").alias("component"), "old"))
        dropped(step)
        dropped(labels)
        labels = after
        if labels.where("component <> old").isEmpty():
            dropped(links)
            return labels.select("id", "component")


def _with(pairs: DataFrame, rows: DataFrame, side: str, names: list[str]) -> DataFrame:
    """Pairs with the named columns of one side; a side that is in many pairs is copied first, so
    that no task gets all pairs of one text."""
    copies = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies"))
    copied = rows.join(copies, rows["id"] == copies[side]).select(
        side, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(f"{side}_copy"), *[F.col(n).alias(f"{side}_{n}") for n in names]
    )
    numbered = pairs.join(copies, side).withColumn(f"{side}_copy", F.pmod(F.xxhash64("a", "b"), F.col("copies")).cast("int")).drop("copies")
    return numbered.join(copied, [side, f"{side}_copy"]).drop(f"{side}_copy")


class _Links:
    """Confirms pairs of representatives."""

    def __init__(self, reps: DataFrame, texts: DataFrame, k: int, percent: int):
        self.reps, self.texts, self.percent = reps, texts, percent
        self.sets = _sets(k)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), the linked ones."""
        pairs = saved(pairs.select("a", "b").distinct())
        both = _with(_with(pairs, self.reps, "a", ["small", "large"]), self.reps, "b", ["small", "large"])
        likely = saved(both.where(_likely("a_small", "a_large", "b_small", "b_large", F.lit(self.percent))).select("a", "b"))
        wanted = saved(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct())
        sets = saved(self.texts.join(small(wanted, BROADCAST_IDS), "id", "left_semi").dropDuplicates(["id"]).select("id", self.sets("text").alias("set")))
        full = _with(_with(likely, sets, "a", ["set"]), sets, "b", ["set"])
        links = saved(full.where(_linked("a_set", "b_set", F.lit(self.percent))).select("a", "b"))
        for table in (pairs, likely, sets):
            dropped(table)
        return links


def _may_link(percent: int) -> Column:
    """Whether sets x and y of given sizes and possible overlaps can reach the threshold."""
    common = F.least("x_most", "y_most")
    return 100 * common >= percent * (F.col("x_n") + F.col("y_n") - common)


def _crowded_links(crowded: DataFrame, links: _Links, k: int, percent: int) -> DataFrame:
    """Links within bands of more than MOST_IN_BAND sets, without listing pairs. crowded: (band, id)."""
    ids = small(saved(crowded.select("id").distinct()), BROADCAST_IDS)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([s.view(np.int64) for a, b in kernels.blocks(texts) for s in kernels.shingle_sets(texts[a:b], k)], dtype=object)

    texts = links.texts.join(ids, "id", "left_semi").dropDuplicates(["id"])
    shingles = texts.select("id", F.explode(hashes("text")).alias("h"))
    # Shingles of one set only: counted, not joined.
    own = shingles.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    most = links.reps.select("id", "n").join(ids, "id", "left_semi").join(own, "id", "left").select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))
    most = saved(most.where(100 * F.col("most") >= percent * F.col("n")))
    members = saved(crowded.join(most, "id"))
    hubs = members.groupBy("band").agg(F.max_by("id", F.struct(F.col("most") / F.col("n"), F.xxhash64("id"))).alias("hub"))
    spokes = members.join(hubs, "band").where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    linked = links.confirmed(spokes)
    labels = components(linked)
    members = members.join(hubs, "band").join(labels, "id", "left")
    hub_label = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    members = members.join(hub_label, "hub", "left").select("band", "id", "n", "most", "component", (F.col("id") == F.col("hub")).alias("is_hub"), F.coalesce(F.col("component") == F.col("hub_component"), F.col("id") == F.col("hub")).alias("with_hub"))
    members = members.groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("c"), F.min(F.col("with_hub").cast("int")).alias("settled"))
    # Shingles in order of frequency: two linked sets share one among the first of each, and what follows
    # its place in both bounds what they can share at all.
    counts = saved(shingles.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    members = saved(members)
    kept = shingles.join(members, "id").join(counts, "h")
    # Shingles of one set only come first of all: they are its n less those that others have, too.
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "h")) + F.col("n") - F.count("*").over(Window.partitionBy("id"))
    first = kept.withColumn("left", F.col("n") - place + 1).where(100 * F.col("left") >= percent * F.col("n"))
    first = saved(first.select("h", "id", "n", "c", "settled", "left"))
    x = first.where("settled = 0").select("h", F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("left").alias("x_most"), F.col("c").alias("x_c"))
    y = first.select("h", F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("left").alias("y_most"), F.col("c").alias("y_c"), F.col("settled").alias("y_settled"))
    each_once = (F.col("y_settled") == 1) | (F.col("x") < F.col("y"))
    rest = x.join(y, "h").where((F.col("x") != F.col("y")) & each_once & _may_link(percent) & ~F.coalesce(F.col("x_c") == F.col("y_c"), F.lit(False)))
    second = links.confirmed(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return linked.unionByName(second)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85, k: int = SHINGLE_WORDS
) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs: the size of its set of k-word shingles
    and the smallest id that links reach from it. Linked are sets with 100 * intersection >= percent
    * union.

    Ids of any type that can be ordered. Rows without words (null, empty, white space) have size 0 and
    are linked with nothing; rows with fewer than k words have one shingle; texts of any length count
    whole. Rows that repeat an id are each judged by their own text (with a second pass over the texts,
    if an id has several); a component's id is the smallest of its rows. A row with a null id stays alone, with a null
    component. Other columns are not read. Links between different texts are missed with a probability
    below 2e-8 each.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, id_col, text, percent, k)


def _near_duplicates(docs: DataFrame, id_col: str, text: str, percent: int, k: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sketched = saved(texts.mapInArrow(_sketches(k, percent), f"id {kind}, n long, set_a long, set_b long, small binary, large binary, bands array<long>"))
    real = sketched.where("n > 0 AND id IS NOT NULL")
    several = real.groupBy("id").agg(F.min("set_a").alias("a"), F.max("set_a").alias("b"), F.min("set_b").alias("c"), F.max("set_b").alias("d")).where("a <> b OR c <> d")
    if not several.isEmpty():
        dropped(sketched)
        return _by_row(docs, id_col, text, percent, k)
    groups = saved(real.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    reps = real.join(groups.select("set_a", "set_b", "n", F.col("rep").alias("id")), ["set_a", "set_b", "n", "id"], "left_semi")
    reps = saved(reps.dropDuplicates(["id"]).select("id", "n", "small", "large", "bands"))

    banded = saved(reps.select("id", F.explode("bands").alias("band")))
    counts = saved(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    met = saved(banded.join(counts, "band"))
    dropped(banded)
    links = _Links(reps, texts, k, percent)

    few = met.where(F.col("c") <= MOST_IN_BAND)
    in_band = few.groupBy("band").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = in_band.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x AS a, y AS b))))")).alias("p")).select("p.a", "p.b")
    found = links.confirmed(pairs)
    crowded = met.where(F.col("c") > MOST_IN_BAND).select("band", "id")
    if not crowded.isEmpty():
        found = found.unionByName(_crowded_links(crowded, links, k, percent))
    labels = components(found)

    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n", "size", F.coalesce("component", "rep").alias("component"))
    shared = groups.where("size > 1").select("rep").unionByName(labels.select(F.col("id").alias("rep"))).distinct()
    named = saved(named.join(groups.join(shared, "rep", "left_semi").select("set_a", "set_b", "n"), ["set_a", "set_b", "n"], "left_semi"))
    rows = sketched.select("id", "n", "set_a", "set_b")
    # Large groups of equal sets, of which there are under HOT_SHARE, are broadcast to their rows.
    most = max(HOT_ROWS, rows.count() // HOT_SHARE)
    by_set = ["set_a", "set_b", "n"]
    hot = F.broadcast(named.where(F.col("size") > most).drop("size"))
    rest = rows.join(hot, by_set, "left_anti").join(named.where(F.col("size") <= most).drop("size"), by_set, "left")
    return rest.unionByName(rows.join(hot, by_set)).select(
        "id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("id").isNotNull(), F.col("component")), F.col("id")).alias("component_id")
    )


def _by_row(docs: DataFrame, id_col: str, text: str, percent: int, k: int) -> DataFrame:
    """near_duplicates for ids that stand for several texts: rows go by a hash of id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    found = near_duplicates(rows, "row", "text", percent, k).dropDuplicates(["id"]).withColumnRenamed("id", "row")
    found = rows.select("id", "row").join(found, "row")
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    return found.join(least, "component_id").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one of each group of near duplicates, that with the smallest id;
    of repeated rows one. Rows without words or id are in no group and stay."""
    own, names, back = numbered(docs)
    its_id = names[id_col]
    found = saved(near_duplicates(own, its_id, names[text], percent))
    gone = saved(found.where("component_id <> id").select(F.col("id").alias("gone")).distinct())
    kept = own.join(small(gone, BROADCAST_IDS), F.col(its_id) == F.col("gone"), "left_anti")
    again = saved(found.where("n_shingles > 0 AND id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("again")))
    dropped(found)
    if again.isEmpty():
        return kept.select(*back)
    again = small(again, BROADCAST_IDS)
    once = kept.join(again, F.col(its_id) == F.col("again"), "left_semi").dropDuplicates([its_id])
    return kept.join(again, F.col(its_id) == F.col("again"), "left_anti").unionByName(once).select(*back)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
         ELSE array_to_string(words[i:i+4], ' ') END AS g
  FROM (SELECT r, doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM pairs JOIN n x ON pairs.a = x.r JOIN n y ON pairs.b = y.r
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.r = n.r LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON w.doc_id = m.a
"""
