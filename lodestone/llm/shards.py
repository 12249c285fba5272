"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, id, row number), so equal texts lie side by side. A sample drawn with a
weight by size and by number gives the splitters: quantile boundaries that cut the order into ranges of about equal
bytes and rows. Records are range-partitioned by binary search in the boundaries, and every range is counted: those
with more than twice `rows_a_range` rows or their share of the bytes are overfull and are subdivided by splitters
sampled inside them, again until none is left. Each range is sorted in a task of its own; the exact bytes and rows before
it come from one small sum per range. A text that a third of the rows share spreads over as many ranges as it needs,
because the id and the row number are part of the order.

The law that holds is `bytes`: a shard holds the records that begin in its equal part of all bytes, so two shards
differ by less than the two largest records and the groups moved. Groups are rows of equal text. A group that a shard
boundary would cut goes whole to the later shard if it has at most `slack` of a shard's bytes; a larger one is cut between
two rows, as no shard could take it whole and stay near equal. Only boundaries and sums per range come to one place.

Defined results: null text has size 1 and CRC-32 0 (no bytes) and is in a group of its own kind; null ids come first
among equal texts; repeated rows get slots of their own; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tables import discard, written

#: How many ranges one round of splitters makes of a range at most; overfull ones are divided again.
FAN_OUT = 4096
KEY = ("k1", "k2", "k3")


def _below(bound: Callable[[Column], list[Column]], n: int | Column, key: list[Column], steps: int) -> Column:
    """How many of n ascending boundaries lie at or below the key, by binary search; bound(i): the parts of the i-th."""

    def step(at: Column, by: Column) -> Column:
        to = at + by
        low = F.lit(True)
        for v, k in reversed(list(zip(bound(to - 1), key, strict=True))):
            low = (v < k) | ((v == k) & low)
        return F.when((to <= n) & low, to).otherwise(at)

    return F.aggregate(F.lit([1 << j for j in range(steps - 1, -1, -1)]), F.lit(0), step)


def _splitters(rows: DataFrame, group: list[str], share: Column, samples: int) -> DataFrame:
    """(group..., cuts array<struct<key>>): quantile boundaries of a weighted sample of each group's rows.

    share: a row's part of its group, in ranges; a row is drawn about `samples` times for each range it fills.
    """
    chance = F.pmod(F.xxhash64(F.lit(4093), *KEY), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.select(*group, *KEY, "parts", F.floor(share * samples + chance).alias("w")).where("w > 0")
    by = W.partitionBy(*group)
    # a group's sample has about samples * FAN_OUT rows at most, whatever the group's size
    before, whole = F.sum("w").over(by.orderBy(*KEY).rowsBetween(W.unboundedPreceding, 0)) - F.col("w"), F.sum("w").over(by)
    place = drawn.withColumn("q", F.floor(before * F.col("parts") / whole))
    cuts = place.where("q > 0").groupBy(*group, "q").agg(F.min(F.struct(*KEY)).alias("b"))
    return cuts.groupBy(*group).agg(F.array_sort(F.collect_set("b")).alias("cuts"))


def _ranged(sized: DataFrame, total: int, rows: int, rows_a_range: int, least_ranges: int, samples: int) -> tuple[DataFrame, int]:
    """sized with a `range` string whose order is that of the key, written; and how many rounds it took.

    A range is overfull if it has too many rows, or too many bytes even without its largest record. Each round samples
    twice as densely as the one before, so in the end every row of an overfull range is a possible boundary.
    """
    wanted = max(least_ranges, -(-rows // rows_a_range))
    full_rows, full_bytes = max(1, 2 * rows // wanted), max(1, 2 * total // wanted)
    now, n = written(sized.withColumn("range", F.lit(""))), 0
    while True:
        sums = now.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most"))
        need = F.greatest(F.lit(2), F.ceil(2 * F.col("n") / full_rows), F.ceil(2 * F.col("bytes") / full_bytes))
        over = sums.where((F.col("n") > full_rows) | (F.col("bytes") - F.col("most") > full_bytes))
        over = written(over.select("range", "bytes", "n", F.least(F.lit(FAN_OUT), need).cast("int").alias("parts")))
        if over.isEmpty():
            discard(over)
            return now, n
        # at first there is one range, so both tables that are joined have one row of at most FAN_OUT boundaries
        small = F.broadcast if n == 0 else lambda df: df
        share = (F.col("size") / F.col("bytes") + 1 / F.col("n")) / 2 * F.col("parts")
        cuts = written(_splitters(now.join(small(over), "range"), ["range"], share, samples << n))
        at = _below(lambda i: [F.get("cuts", i)[k] for k in KEY], F.size("cuts"), [F.col(k) for k in KEY], FAN_OUT.bit_length())
        name = F.when(F.col("cuts").isNull(), F.col("range")).otherwise(F.concat("range", F.lpad(at.cast("string"), 4, "0")))
        divided = written(now.join(small(cuts), "range", "left").withColumn("range", name).drop("cuts"))
        for df in (over, cuts, now):
            discard(df)
        now, n = divided, n + 1


def sharded(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", rows_a_range: int = 2_000_000, least_ranges: int = 256, samples_a_range: int = 32, slack: float = 0.01) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row under the law `bytes`."""
    binary = F.col(text_col).cast("binary")
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(binary), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.xxhash64(binary), F.lit(0)).alias("k1"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        )
    )
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranged, _ = _ranged(sized, total, rows, rows_a_range, least_ranges, samples_a_range)
    discard(sized)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # one row a range
    offsets = written(sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0")))
    inside = W.partitionBy("range").orderBy(*KEY)
    placed = written(
        ranged.select("*", (F.row_number().over(inside) - 1).alias("nth"), (F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("begin"))
        .join(offsets, "range")
        .select("id", "size", "text_crc32", "k1", (F.col("bytes0") + F.col("begin")).alias("begin"), (F.col("rows0") + F.col("nth")).alias("at"))
    )
    discard(ranged)
    cuts = _cuts(placed, shards, total, slack)
    bytes_ = F.lit([b for b, _ in cuts] or [0])
    shard = _below(lambda i: [F.get(bytes_, i)], len(cuts), [F.col("begin")], len(cuts).bit_length()) if cuts else F.lit(0)
    first = F.get(F.lit([0, *[a for _, a in cuts]]), F.col("shard"))
    return placed.withColumn("shard", shard.cast("int")).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") - first).cast("long").alias("slot"))


def _cuts(placed: DataFrame, shards: int, total: int, slack: float) -> list[tuple[int, int]]:
    """(first byte, first row) of every shard but the first: at most `shards` rows come to the driver."""
    part = F.floor(F.col("begin") * shards / F.lit(max(1, total)))
    starts = placed.groupBy(part.alias("s")).agg(F.min(F.struct("begin", "at", "k1")).alias("x")).where("s > 0").select("s", "x.*").collect()
    cut = {r["k1"] for r in starts}
    groups = placed.where(F.col("k1").isin(*cut)) if cut else placed.limit(0)
    whole = {r["k1"]: r for r in groups.groupBy("k1").agg(F.min("begin").alias("begin"), F.min("at").alias("at"), F.sum("size").alias("bytes")).collect()}
    found: dict[int, tuple[int, int]] = {}
    for r in starts:
        group = whole[r["k1"]]
        fits = group["bytes"] <= slack * total / shards
        found[int(r["s"])] = (group["begin"], group["at"]) if fits else (r["begin"], r["at"])
    end = placed.agg(F.count("*")).first()[0] if len(found) < shards - 1 else 0
    cuts = []
    for s in range(shards - 1, 0, -1):  # a shard in whose part no record begins is empty
        cuts.append(found.get(s) or (cuts[-1] if cuts else (total, end)))
    return cuts[::-1]
