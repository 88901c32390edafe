"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash within their source, ranked, and sorted by their fractional
rank (rank - 1/2) / rows of the source; the sorted sequence is cut into runs of equal length. Every
run of it, and so every shard, holds each source in its share of the whole, within a row or so.

Neither ranks nor positions are counted in one task: a source is cut into BINS by the leading bits
of the hash and the sequence into BINS by fraction; counts per bin give each bin its offset. A bin
that one id crowds is cut further, by the checksums of that id's texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED, BINS = 16, "shards-1", 1 << 13
#: A bin is crowded if it has so many rows and so many times the rows of a usual one.
CROWDED, TIMES = 10_000, 4
#: Checksums of one crowded id are cut into so many ranges; repeated rows come in runs of so many.
RANGES, RUN = 1 << 10, 1 << 12
CELL = ["source", "bin", "segment", "range"]


def shuffle_key(key: Column, seed: str) -> Column:
    """60 bits of the MD5 of seed and key, as a long; null keys hash as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _cells(rows: DataFrame) -> DataFrame:
    """``segment`` and ``range``: parts of a bin that follow each other in the order of rows.

    A bin is one part, unless it is crowded by an id that very many rows share (or lack): then the
    rows before, of and after such an id are segments, and its own rows are cut by ranges of the
    texts' checksum, which is what orders them."""
    plain = [F.lit(0).alias("segment"), F.lit(0).cast("long").alias("range")]
    counts = rows.groupBy("source", "bin").agg(F.sum("m").alias("n"))
    usual = F.sum("n").over(Window.partitionBy("source")) / BINS  # BINS rows of a source at most
    crowded = counts.withColumn("usual", usual).where((F.col("n") > CROWDED) & (F.col("n") > TIMES * F.col("usual"))).select("source", "bin")
    if crowded.isEmpty():
        return rows.select("*", *plain)
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bin") == F.col("c.bin"))
    inside = rows.select("source", "bin", "h", "m").alias("r").join(crowded.alias("c"), same, "left_semi")
    heavy = inside.groupBy("source", "bin", "h").agg(F.sum("m").alias("n")).where(F.col("n") > CROWDED // 2)
    lists = heavy.groupBy("source", "bin").agg(F.array_sort(F.collect_list("h")).alias("heavy"))  # a bin's rows / CROWDED at most
    met = rows.alias("r").join(lists.alias("c"), same, "left").select("r.*", F.coalesce("c.heavy", F.array().cast("array<bigint>")).alias("heavy"))
    own = F.array_contains("heavy", F.col("h"))
    segment = 2 * F.size(F.filter("heavy", lambda x: x < F.col("h"))) + own.cast("int")
    ranged = F.when(own, F.expr(f"crc div {(1 << 32) // RANGES}")).otherwise(0).cast("long")
    return met.select(*rows.columns, segment.alias("segment"), ranged.alias("range"))


def _repeated(rows: DataFrame) -> DataFrame:
    """``m`` rows in the place of each, with their ranks; what repeats very often is spread by runs."""
    few, many = rows.where(F.col("m") <= RUN), rows.where(F.col("m") > RUN)
    one = lambda df: df.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("m") - 1)))
    runs = many.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RUN}")))).repartition("_run", "h")
    runs = runs.withColumn("rank", F.col("rank") + F.col("_run") * RUN).withColumn("m", F.least(F.lit(RUN).cast("long"), F.col("m") - F.col("_run") * RUN))
    return one(few).unionByName(one(runs.drop("_run")))


def interleave(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, seed: str = SEED, copies: str | None = None
) -> DataFrame:
    """``row`` (all columns of the input, as a struct), ``shard`` from 0 and ``slot`` from 0, gapless.

    Shards differ by at most one row. Equal keys are ordered by the CRC-32 and length of the text;
    rows equal in all of these are interchangeable. ``copies``: a column that says how many rows a row
    stands for. Null sources are a source. No rows: no rows."""
    blank = F.coalesce(df[text], F.lit(""))
    rows = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("row"),
        df[source].cast("string").alias("source"),
        shuffle_key(df[key], seed).alias("h"),
        df[key].alias("key"),
        F.crc32(blank).alias("crc"),
        F.length(blank).alias("length"),
        (F.lit(1) if copies is None else df[copies]).cast("long").alias("m"),
    )
    rows = _cells(rows.withColumn("bin", F.floor(F.col("h") / F.lit((1 << 60) // BINS)).cast("int")))
    ties = ["h", "key", "crc", "length"]
    same = F.col("rows.source").eqNullSafe(F.col("cells.source"))
    for c in CELL[1:]:
        same = same & (F.col(f"rows.{c}") == F.col(f"cells.{c}"))
    counts = rows.groupBy(*CELL).agg(F.sum("m").alias("n"))
    by_source = Window.partitionBy("source")
    counts = counts.select(
        *CELL,
        (F.sum("n").over(by_source.orderBy(*CELL[1:])) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("total"),
    )
    upto = Window.partitionBy(*CELL).orderBy(*ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", F.sum("m").over(upto) - F.col("m") + 1)
    ranked = ranked.alias("rows").join(counts.alias("cells"), same).select(
        "row", F.col("rows.source").alias("source"), *ties, "m", (F.col("rank") + F.col("before")).alias("rank"), "total"
    )
    ranked = ranked if copies is None else _repeated(ranked)
    ranked = ranked.select("row", "source", *ties, ((F.col("rank") - 0.5) / F.col("total")).alias("fraction"))
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * BINS).cast("int"))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    everything = Window.orderBy("part")  # BINS rows at most
    parts = parts.select(
        "part",
        (F.sum("n").over(everything) - F.col("n")).alias("before"),
        F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("fraction", "h", F.col("source").asc_nulls_first(), "key", "crc", "length")
    placed = ranked.withColumn("at", F.row_number().over(inside)).join(parts, "part")
    position = F.col("at") + F.col("before") - 1
    placed = placed.select("row", position.alias("position"), "total")
    shard = F.expr(f"(position * {shards}) div total")
    # the first position of a shard is the smallest p with p * shards >= shard * total
    start = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select("row", F.col("shard").cast("int").alias("shard"), (F.col("position") - start).cast("long").alias("slot"))


def shard_documents(df: DataFrame, shards: int = SHARDS, **columns: str) -> DataFrame:
    """All columns of the input with ``shard`` and ``slot``, which replace columns of those names."""
    placed = interleave(df, shards=shards, **columns)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", "slot")


def digest_shards(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the UTF-8 length of the text plus 1; a null text has no bytes and the CRC of none."""
    blank = F.coalesce(df["text"], F.lit(""))
    narrow = df.select("doc_id", "source", "text", (F.octet_length(blank) + 1).cast("long").alias("size"), F.crc32(blank).alias("text_crc32"))
    # text only breaks ties: its stand-in here is as long and as short as a checksum
    narrow = narrow.withColumn("text", F.concat_ws(":", "text_crc32", "size"))
    # rows equal in all of this are one row and a count
    counted = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("copies"))
    placed = interleave(counted, shards=shards, copies="copies")
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.size").alias("size"),
        F.col("row.text_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
