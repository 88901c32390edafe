"""Benchmark decontamination by size-partitioned MinHash containment, with DataFrame functions only.

An item leaks into a document if at least THRESHOLD of its different shingles (five words, lower
case) are in the document. Items are partitioned by size, in classes of a factor two. In a class of
at most u shingles an item that leaks misses at most m = floor((1 - THRESHOLD) * u) of its own, so
of its m + 1 smallest shingle hashes, its MinHash sketch, one at least is in the document. Sketches
are looked up for every shingle of every document, however long, and the pairs found are verified
by counting the shingles themselves. So the search misses nothing that the definition names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inversia.llm.workspace import Workspace, words

SHINGLE, THRESHOLD = 5, 0.8
#: A table of sketches, shingles or keys is broadcast up to so many bytes; beyond, the join shuffles.
MOST_BROADCAST, ROW_BYTES = 32 << 20, 32


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, two hashes that stand for the text, and its words."""
    plain = F.coalesce(df[text], F.lit(""))
    return df.select(
        df[key].alias("key"), F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit(1), plain).alias("t2"), words(F.lower(df[text])).alias("words")
    )


def _word(i: int) -> Column:
    return F.get("words", F.col("at") + i)


def _at(table: DataFrame, width: int) -> DataFrame:
    """One row per shingle of ``width`` words, ``at`` its first word; shorter texts have none."""
    long_enough = table.where(F.size("words") >= width)
    return long_enough.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - width)))


def _hash(width: int) -> Column:
    return F.xxhash64(F.lit(width), *[_word(i) for i in range(width)])


def item_shingles(benchmark: DataFrame, key: str = "item_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``item``, ``width``, ``n`` (different shingles), ``h``, ``s`` (hash and text of each).

    An item of fewer words than ``shingle`` is one shingle of all its words; one without words has
    none. Items with the same key and different texts are different; repeated items are one."""
    table = _texts(benchmark, key, text).distinct().withColumnRenamed("key", "item")
    parts = []
    for width in range(1, shingle + 1):
        fits = F.size("words") == width if width < shingle else F.size("words") >= shingle
        found = _at(table.where(fits), width)
        s = F.concat_ws(" ", *[_word(i) for i in range(width)])
        parts.append(found.select("item", "t1", F.lit(width).alias("width"), _hash(width).alias("h"), s.alias("s")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.distinct()
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("item", "t1")))


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``item``, ``t1``, ``width``, ``h``: the smallest hashes of each item, as many as its size
    class needs for one to be left wherever ``threshold`` of the item is."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    needed = F.floor((1 - F.lit(threshold)) * upper + 1e-9) + 1
    smallest = F.row_number().over(Window.partitionBy("item", "t1").orderBy("h"))
    return shingles.withColumn("place", smallest).where(F.col("place") <= needed).select("item", "t1", "width", "h")


def small(table: DataFrame) -> DataFrame:
    """Marked for broadcast if its size in bytes was checked, else left to the planner."""
    lengths = [F.octet_length(F.col(f.name).cast("string")) for f in table.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    width = sum((F.coalesce(x, F.lit(0)) for x in lengths), F.lit(ROW_BYTES + 16 * len(table.columns)))
    size = table.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= MOST_BROADCAST else table


def find_leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE
) -> DataFrame:
    """``key``, ``t1``, ``t2``, ``item``, ``n_shingles``, ``n_shared``, ``containment`` of every leak.

    One row per different (key, text) and item; null keys and null item keys are kept. Null and
    empty texts have no shingles. ``threshold`` must be above 0."""
    space = Workspace(df.sparkSession, "decontaminate")
    shingles = space.keep(item_shingles(benchmark, text="text", shingle=shingle), "items")
    sketch = space.keep(sketches(shingles, threshold), "sketches")
    widths = sorted(r["width"] for r in sketch.select("width").distinct().collect())  # 1 to shingle
    texts = _texts(df, key, text)
    found = None
    for width in widths:
        probes = _at(texts, width).select("key", "t1", "t2", _hash(width).alias("h"))
        own = sketch.where(F.col("width") == width).select("item", F.col("t1").alias("item_text"), "h")
        pairs = probes.join(small(own), "h").select("key", "t1", "t2", "item", "item_text")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:  # no items: nothing leaks
        none = F.lit(None).cast(sketch.schema["item"].dataType).alias("item")
        found = texts.limit(0).select("key", "t1", "t2", none, F.lit(None).cast("long").alias("item_text"))
    pairs = space.keep(found.distinct(), "pairs")
    # verified on the words of the texts that were found, by the shingles' own text
    same = F.col("d.key").eqNullSafe(F.col("p.key")) & (F.col("d.t1") == F.col("p.t1")) & (F.col("d.t2") == F.col("p.t2"))
    wanted = pairs.select("key", "t1", "t2").distinct()
    opened = texts.alias("d").join(wanted.alias("p"), same, "left_semi")
    counted = None
    for width in widths:
        s = F.concat_ws(" ", *[_word(i) for i in range(width)])
        own = shingles.where(F.col("width") == width).select("item", F.col("t1").alias("item_text"), "n", "s")
        shared = _at(opened, width).select("key", "t1", "t2", s.alias("s")).join(small(own), "s").select("key", "t1", "t2", "item", "item_text", "n", "s")
        counted = shared if counted is None else counted.unionByName(shared)
    columns = ["key", "t1", "t2", "item", "item_text"]
    if counted is None:
        return pairs.select(*columns[:4], *[F.lit(None).cast(t).alias(c) for c, t in (("n_shingles", "long"), ("n_shared", "long"), ("containment", "double"))])
    sums = counted.distinct().groupBy(*columns, "n").agg(F.count("*").alias("n_shared"))
    matched = F.col("s.key").eqNullSafe(F.col("p.key")) & F.col("s.item").eqNullSafe(F.col("p.item"))
    for c in ("t1", "t2", "item_text"):
        matched = matched & (F.col(f"s.{c}") == F.col(f"p.{c}"))
    sums = sums.alias("s").join(pairs.alias("p"), matched, "left_semi")
    share = F.col("n_shared") / F.col("n")
    return sums.where(share >= threshold - 1e-12).select("key", "t1", "t2", "item", F.col("n").alias("n_shingles"), "n_shared", share.alias("containment"))


def leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shingles``, ``n_shared``, ``containment`` of every leak."""
    found = find_leaks(df, benchmark)
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", "containment")


def drop_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text holds no item, with all their columns. Equal texts fare alike."""
    found = find_leaks(df, benchmark, key, text, threshold).select("t1", "t2").distinct()
    plain = F.coalesce(df[text], F.lit(""))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit(1), plain).alias("t2"))
    clean = rows.join(found, ["t1", "t2"], "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
