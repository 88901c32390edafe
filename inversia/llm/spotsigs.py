"""SpotSigs: fingerprints of chains of content words that follow common words.

A signature is an anchor with the next CHAIN content words after it. Anchors are common words
(of the languages listed) and, so that texts without any still have signatures, the content words
whose hash falls into one class of ANCHOR_CLASSES. A text too short for any such chain has one
signature, all its words. The fingerprint of a text is the set of its signatures; two are compared
by Jaccard likeness, which is never more than the smaller set's share of the larger."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.components import connected_components
from inversia.llm.workspace import Workspace, per_batch

# Common words by language: fixed values.
COMMON_WORDS = {
    "en": "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or she that the their they this to was we were will with you",
    "de": "als am an auch auf aus bei das dem den der des die ein eine einen es für hat ich im in ist mit nach nicht sich sie sind so über um und von war wie wird zu zum",
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
    "es": "a al con de del el ella en entre es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y ya",
    "it": "alla che con da dei del della di e gli ha il la le nel non per più si sono un una",
    "pt": "ao as com da das do dos em foi mais na no não os ou para pela pelo por se sua um uma",
}
CHAIN, ANCHOR_CLASSES = 2, 8
_WORD = re.compile(r"\w+")
_COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
_MIX = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 400_000


class _WordHashes(dict):
    """Hash of a word with its lowest bit set for common words; a bounded memory per worker."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | (word in _COMMON)
        if len(self) < REMEMBERED and len(word) <= 40:
            self[word] = value
        return value


_HASHES = _WordHashes()


def signatures(text: str) -> np.ndarray:
    """The text's set of signatures: sorted, different 64-bit numbers. Empty without words."""
    found = np.array([_HASHES[w] for w in _WORD.findall(text.lower())], np.uint64)
    if not len(found):
        return found
    common = (found & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common | ((found >> np.uint64(1)) % np.uint64(ANCHOR_CLASSES) == 0))
    first = np.searchsorted(content, anchors, "right")  # the first content word after each anchor
    whole = first + CHAIN <= len(content)
    anchors, first = anchors[whole], first[whole]
    if not len(anchors):
        return np.array([xxhash.xxh64_intdigest(found.tobytes())], np.uint64)
    chain = found[anchors]
    for k in range(CHAIN):
        chain = (chain ^ (chain >> np.uint64(29))) * _MIX + found[content[first + k]]
    return np.unique(chain)


def digest(found: np.ndarray) -> str:
    """Set length and a hash of the set: equal sets, equal strings."""
    return f"{len(found)}-{xxhash.xxh128_hexdigest(found.tobytes())}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sets; 1 for two empty ones. Below ``least`` for certain: 0, unread."""
    small, large = sorted((len(a), len(b)))
    if large == 0:
        return 1.0
    if small < least * large or small == 0:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


FIELDS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = signatures(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), sha, digest(own), digest(other), likeness(own, other), likeness(own, next_own)


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and FIELDS of every row; the next row is that of the next smaller key.

    Null texts count as empty; null keys come after all others; rows of equal keys follow by the
    hash of the text. After the last row comes the first; a table of one row is its own next.

    Texts are shuffled once, by ranges of the key, and a task compares neighbours as it reads them
    in order. Only the first and last text of each task's range goes on to meet its neighbour."""
    spark = df.sparkSession
    space = Workspace(spark, "spotsigs")
    rows = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("key").desc_nulls_last(), F.col("tie")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for k, t, tie in zip(*(c.to_pylist() for c in batch.columns)):
                own = signatures(t)
                if before is None:
                    out.append(("first", k, tie, t, *[None] * len(FIELDS)))
                else:
                    out.append(("done", before[0], before[1], None, *compare(before[2], before[3], t, own)))
                before = (k, tie, t, own)
            yield _rows(out, schema)
        if before is not None:
            yield _rows([("last", *before[:3], *[None] * len(FIELDS))], schema)

    staged = f"part string, key {kind}, tie long, text string, {RESULT}"
    schema = _arrow_schema(kind)
    found = space.keep(ranged.mapInArrow(run, staged), "neighbours")
    # two rows per task of the shuffle, not more: the ends of its range, in order
    ends = found.where("part != 'done'").select("part", "key", "tie", "text")
    pairs = meet_ends(ends)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, following in zip(*(c.to_pylist() for c in batch.columns)):
                out.append(("done", k, None, None, *compare(t, signatures(t), following, signatures(following))))
            yield _rows(out, schema)

    closed = pairs.mapInArrow(join, staged)
    done = found.where("part = 'done'").select("key", *FIELDS).unionByName(closed.select("key", *FIELDS))
    return done.withColumnRenamed("key", key)


def meet_ends(ends: DataFrame) -> DataFrame:
    """Each range's last row with the first row of the next range, the first range after the last.

    Bounded: two rows per range. Ranges don't overlap, so their ends in order alternate."""
    order = "ORDER BY key DESC NULLS LAST, tie, part"
    return ends.selectExpr(
        "part", "key", "text AS own", f"coalesce(lead(text) OVER ({order}), first(text) OVER ({order})) AS following"
    ).where("part = 'last'").drop("part")


def with_signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fingerprint``, ``found`` (the set of signatures as longs) of every row."""
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [signatures(t or "") for t in batch.column(1).to_pylist()]
            sets = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(f) for f in found], pa.string()), sets], ["key", "fingerprint", "found"])

        return work

    return per_batch(narrow, make, f"key {narrow.schema['key'].dataType.simpleString()}, fingerprint string, found array<long>")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``key``, ``fingerprint``, ``class_id`` of every row: the smallest key among the texts that links
    of likeness ``threshold`` or more reach. Texts without words are one class; classes of null
    keys only have a null id.

    Sets are partitioned by length, in classes of a factor 1 / threshold, so that a set meets only
    its own class and the next smaller one. There it meets the sets that share one of its rarest
    signatures: of two sets that are alike enough, the first n - ceil(threshold * n) + 1 in the
    order of rarity have one in common. The pairs are compared by Jaccard with the length bound.
    Equal sets are one node throughout."""
    space = Workspace(df.sparkSession, "near-copies")
    rows = space.keep(with_signatures(df, key, text), "signatures")
    sets = space.keep(rows.groupBy("fingerprint").agg(F.min("key").alias("least"), F.first("found").alias("found")), "sets")
    each = sets.where(F.size("found") > 0).select("fingerprint", F.size("found").alias("n"), F.explode("found").alias("signature"))
    frequency = each.groupBy("signature").agg(F.count("*").alias("texts")).where("texts > 1")
    # a signature of one text leads to no pair, but it counts as the rarest of its set
    ranked = each.join(frequency, "signature", "left").groupBy("fingerprint", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), F.col("signature")))).alias("by_rarity")
    )
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold) if threshold < 1 else math.inf) + 1e-9).cast("int")
    heads = ranked.select("fingerprint", "n", part.alias("part"), F.explode(F.slice("by_rarity", F.lit(1), prefix.cast("int"))).alias("s"))
    heads = space.keep(heads.where("s.texts > 1").select("fingerprint", "n", "part", F.col("s.signature").alias("signature")), "heads")
    small = heads.alias("a")
    large = heads.withColumn("part", F.explode(F.array("part", F.col("part") - 1))).alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.fingerprint") < F.col("b.fingerprint")))
    met = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.part") == F.col("b.part")) & ordered & (F.col("a.n") >= F.col("b.n") * threshold - 1e-9)
    pairs = small.join(large, met).select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b")).distinct()
    own = sets.select("fingerprint", "found")
    both = pairs.join(own.withColumnsRenamed({"fingerprint": "a", "found": "found_a"}), "a").join(
        own.withColumnsRenamed({"fingerprint": "b", "found": "found_b"}), "b"
    )

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a", "b")]
            found = [[np.array(x, np.int64) for x in batch.column(c).to_pylist()] for c in ("found_a", "found_b")]
            near = [likeness(x, y, threshold) >= threshold - 1e-12 for x, y in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()).filter(pa.array(near, pa.bool_())) for c in columns], ["a", "b"])

    links = both.select("a", "b", "found_a", "found_b").mapInArrow(alike, "a string, b string")
    labels = space.keep(connected_components(links, space), "labels")
    labelled = sets.join(labels, sets["fingerprint"] == labels["node"], "left").select("fingerprint", F.coalesce("label", "fingerprint").alias("label"), "least")
    classes = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    named = labelled.join(classes, "label").select("fingerprint", "class_id")
    return rows.join(named, "fingerprint").select(F.col("key").alias(key), "fingerprint", "class_id")


def _arrow_schema(kind: str) -> pa.Schema:
    keys = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}
    if kind not in keys:
        raise TypeError(f"a key of type {kind}")
    fields = [("part", pa.string()), ("key", keys[kind]), ("tie", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64())]
    fields += [(n, pa.string()) for n in FIELDS[1:4]] + [(n, pa.float64()) for n in FIELDS[4:]]
    return pa.schema(fields)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
