"""Exact removal of repeated substrings, over all documents.

Every byte covered by a WIDTH-byte string that also starts earlier goes. Suffix sorting finds equal
strings; these steps bring equal strings together, and to the sorter only text that needs it.

1. Anchors: the ANCHOR-byte piece of least hash in each string of WIDTH bytes. Equal strings have
   equal anchors at equal places. Neighbouring strings share their anchor, so a document is a row of
   stretches, each with its anchor, and only a hash of the anchor and one of the stretch move.
2. Stretches meet by anchor, equal ones combined before they are sent. Of those that are equal altogether, the earliest keeps its strings as
   far as its own class goes and all strings of the others are repeats. An anchor with one class of
   stretches is done.
3. Where one anchor has several classes, their earliest stretches are sent as text. Each task sorts
   the suffixes of what it gets, its shard, by external induced sorting, which carries the length of
   the prefix that neighbours in the order share: runs of WIDTH or more are equal strings, and all
   but the earliest of a run are repeats.
4. An anchor with more than MOST_CLASSES classes would make a shard that grows with the table. Its
   stretches are taken apart into single strings, which meet by their own hash as in step 2.
5. Repeats are gathered by document and cut out of its text.

Document order: by key (null last), then by a hash of the text; rows equal in both are judged as
one document. Texts are handled as UTF-8 bytes; a null text is empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inversia.llm.induced import SuffixSorter
from inversia.llm.workspace import Workspace, bytes_of, per_batch

WIDTH, ANCHOR = 100, 32
STARTS = WIDTH - ANCHOR + 1
#: Bytes of text whose anchors are found at once.
BLOCK = 1 << 20
#: Bits of the filter that picks stretches to send: a bound on what is broadcast (16 MB); and up to how
#: many stretches it is used, with under 1 % let through in error. More of them are joined to their texts.
FILTER_BITS = 27
MOST_FILTERED = 1 << (FILTER_BITS - 5)
#: Text of a shard as planned, and classes of an anchor that may be in one.
SHARD_BYTES, MOST_CLASSES = 4 << 20, 20_000
LAST = (1 << 63) - 1
# a stretch's place in one long: anchor position, string starts before the anchor, and how many
# of the STARTS starts nearest to it are left out
_FIELD = 7
SHAPE, SIGN = (1 << 2 * _FIELD) - 1, np.int64(-(2**63))
#: Stretches told apart in one block before they are shuffled.
COMBINED = 1 << 17


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string in ``data`` (uint8): its anchor's position and hash."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span = 1
    factor = 0x100000001B3
    while span < ANCHOR:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor & (2**64 - 1)
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = np.uint64(2 * BLOCK - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= STARTS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = STARTS - span
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    at = (least & low).astype(np.int64)
    return at, h


def stretches(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, anchor position, first start, last start) of a text's stretches, in blocks."""
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, len(data) - WIDTH + 1, BLOCK):
        at, h = anchors(data[begin : begin + BLOCK + WIDTH - 1])
        change = np.flatnonzero(at[1:] != at[:-1])
        first = np.concatenate([[0], change + 1])
        last = np.append(change, len(at) - 1)
        yield h[at[first]].view(np.int64), at[first] + begin, first + begin, last + begin


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (at << 2 * _FIELD) | ((at - first) << _FIELD) | (at - last)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last start."""
    mask, at = (1 << _FIELD) - 1, place >> 2 * _FIELD
    return at, at - ((place >> _FIELD) & mask), at - (place & mask)


def _many_texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Key, tie and text of rows that have a string at all."""
    for key, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))):
        if text is not None and len(text) >= WIDTH:
            yield key, tie, text


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, stretch (hash), place, key, tie; told apart in blocks first, see ``_combined``."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts: list[tuple] = []
        rows = 0
        for key, tie, text in _many_texts(batch):
            view = memoryview(text)
            for h, at, first, last in stretches(text):
                own = [digest(view[i : j + WIDTH]) for i, j in zip(first.tolist(), last.tolist())]
                parts.append((h, np.array(own, np.uint64).view(np.int64), _pack(at, first, last), np.full(len(h), key), np.full(len(h), tie)))
                rows += len(h)
            if rows >= COMBINED:
                yield _combined(parts)
                parts, rows = [], 0
        if parts:
            yield _combined(parts)


NAMES = ["anchor", "stretch", "place", "key", "tie"]
SCHEMA = "anchor long, stretch long, place long, key long, tie long"


def _combined(parts: list[tuple]) -> pa.RecordBatch:
    """Rows of one block. Of a class only the earliest is still to be judged, so a stretch that
    comes often goes to its anchor's task once per block. The others are repeats: their place
    is marked by its sign, and instead of the anchor they get a number that spreads them."""
    anchor, stretch, place, key, tie = (np.concatenate(c) for c in zip(*parts))
    shape = place & SHAPE
    mixed = anchor ^ (stretch * np.int64(0x1E3779B97F4A7C15)) ^ shape
    order = np.lexsort((place, tie, key, mixed))
    anchor, stretch, place, key, tie, shape = (c[order] for c in (anchor, stretch, place, key, tie, shape))
    same = np.zeros(len(order), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (stretch[1:] == stretch[:-1]) & (shape[1:] == shape[:-1])
    again = same.copy()  # the same place of the same document, from an equal row
    again[1:] &= (place[1:] == place[:-1]) & (key[1:] == key[:-1]) & (tie[1:] == tie[:-1])
    spread = _row_hash(anchor=anchor, place=place, key=key, tie=tie).view(np.int64)
    anchor, place = np.where(same, spread, anchor), np.where(same, place | SIGN, place)
    return pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in (anchor, stretch, place, key, tie)], NAMES)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, class, document): those that matter, with ``open``.

    ``open`` false: all its strings are repeats. True: the earliest of its class, where the anchor
    has several classes. Groups are read as a stream; only the last row is kept back."""
    held: np.ndarray | None = None  # the last first-of-class row, not yet told
    held_open, last_row = False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(5)])
        marked = rows[2] < 0  # repeats already
        if marked.any():
            known = rows[:, marked]
            known[2] &= ~SIGN
            yield _told(known, np.zeros(known.shape[1], bool))
            rows = rows[:, ~marked]
            if not rows.shape[1]:
                continue
        before = np.concatenate([rows[:, :1] if last_row is None else last_row, rows[:, :-1]], axis=1)
        anchor_new = rows[0] != before[0]
        class_new = anchor_new | (rows[1] != before[1]) | ((rows[2] ^ before[2]) & SHAPE != 0)
        if last_row is None:
            anchor_new[0] = class_new[0] = True
        same_row = ~class_new & (rows[2] == before[2]) & (rows[3] == before[3]) & (rows[4] == before[4])
        repeats = rows[:, ~class_new & ~same_row]
        if repeats.shape[1]:
            yield _told(repeats, np.zeros(repeats.shape[1], bool))
        firsts = rows[:, class_new]
        if firsts.shape[1]:
            if held is not None:
                firsts = np.concatenate([held, firsts], axis=1)
            joined = firsts[0, 1:] == firsts[0, :-1]
            several = np.zeros(firsts.shape[1], bool)
            several[1:] |= joined
            several[:-1] |= joined
            several[0] |= held is not None and held_open
            held, held_open = firsts[:, -1:].copy(), bool(several[-1])
            done = firsts[:, :-1][:, several[:-1]]
            if done.shape[1]:
                yield _told(done, np.ones(done.shape[1], bool))
        last_row = rows[:, -1:].copy()
    if held is not None and held_open:
        yield _told(held, np.ones(1, bool))


def _told(rows: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r)) for r in rows] + [pa.array(flag)], [*NAMES, "open"])


def _row_hash(**columns: np.ndarray) -> np.ndarray:
    """One number for a stretch of a document; equal numbers only send a stretch too many."""
    c = {k: np.asarray(v).astype(np.int64).view(np.uint64) for k, v in columns.items()}
    h = c["anchor"] ^ (c["place"] * np.uint64(0x9E3779B97F4A7C15)) ^ (c["key"] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c["tie"] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(FILTER_BITS)) & mask).astype(np.int64)


def _anchor_hash(anchor: np.ndarray) -> np.ndarray:
    zero = np.zeros(len(anchor), np.int64)
    return _row_hash(anchor=anchor, place=zero, key=zero, tie=zero)


def _filter_of(rows: DataFrame, whole: bool) -> np.ndarray:
    """A Bloom filter of the rows' stretches (``whole``) or anchors, 2**FILTER_BITS bits however
    many there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_numpy() for n in ("anchor", "place", "key", "tie")}
            both = np.concatenate(_bits(_row_hash(**columns) if whole else _anchor_hash(columns["anchor"])))
            word, place = np.unique(both >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, place, np.uint64(1) << (both & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    found = rows.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for x in _bits(hashes):
        found &= (words[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def _open_stretches(batch: pa.RecordBatch, wanted: np.ndarray, many: np.ndarray | None, of_many: bool) -> Iterator[tuple]:
    """(text, key, tie, anchor, first, last) of the wanted stretches, of anchors with many classes or
    of the others. A filter lets a few too many pass, which changes no result."""
    for key, tie, text in _many_texts(batch):
        for h, at, first, last in stretches(text):
            n = len(h)
            chosen = _passes(wanted, _row_hash(anchor=h, place=_pack(at, first, last), key=np.full(n, key), tie=np.full(n, tie)))
            if many is not None:
                chosen &= _passes(many, _anchor_hash(h)) == of_many
            for i in np.flatnonzero(chosen).tolist():
                yield text, key, tie, int(h[i]), int(first[i]), int(last[i])


def _texts_of(docs: DataFrame, wanted: np.ndarray, many: np.ndarray | None) -> DataFrame:
    """The wanted stretches with their text, but for anchors with many classes."""
    sent = docs.sparkSession.sparkContext.broadcast((wanted, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _sent_pieces(_open_stretches(batch, *sent.value, False))

    return docs.mapInArrow(run, PIECES)


def _strings_of(docs: DataFrame, wanted: np.ndarray, many: np.ndarray) -> DataFrame:
    """Every string of the wanted stretches whose anchors have many classes, as a stretch of its own
    under its own hash."""
    sent = docs.sparkSession.sparkContext.broadcast((wanted, many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _single_strings(_open_stretches(batch, *sent.value, True))

    return docs.mapInArrow(run, SCHEMA)


def _single_strings(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Each string of the stretches as a stretch of its own; its 128-bit hash is its anchor and class."""
    digest, low = xxhash.xxh3_128_intdigest, (1 << 64) - 1
    parts, rows = [], 0
    for text, key, tie, _, first, last in found:
        start = np.arange(first, last + 1)
        hashes = [digest(text[i : i + WIDTH]) for i in start.tolist()]
        own, rest = (np.array([h >> shift & low for h in hashes], np.uint64).view(np.int64) for shift in (0, 64))
        n = len(start)
        parts.append((own, rest, _pack(start, start, start), np.full(n, key), np.full(n, tie)))
        rows += n
        if rows >= COMBINED:
            yield _combined(parts)
            parts, rows = [], 0
    if parts:
        yield _combined(parts)


def _with_open(docs: DataFrame, unsure: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """``key``, ``tie``, ``text`` and ``open`` (anchor, place, many: whether the anchor has many classes)
    of the documents that have open stretches: the exact way where they are too many for a filter."""
    large = classes.where(F.col("n") > most).select("anchor", F.lit(True).alias("many"))
    marked = unsure.join(large, "anchor", "left").select("key", "tie", F.struct("anchor", "place", F.coalesce("many", F.lit(False)).alias("many")).alias("one"))
    by_document = marked.groupBy("key", "tie").agg(F.collect_list("one").alias("open"))  # a document's own stretches
    return docs.join(by_document, ["key", "tie"]).select("key", "tie", "text", "open.anchor", "open.place", "open.many")


def _opened(batch: pa.RecordBatch, of_many: bool) -> Iterator[tuple]:
    """As ``_open_stretches``, of rows of ``_with_open``."""
    keys, ties, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))
    for key, tie, text, anchor, place, many in zip(keys, ties, texts, *(batch.column(c).to_pylist() for c in (3, 4, 5))):
        _, first, last = _unpack(np.array(place, np.int64))
        for i in range(len(place)):
            if many[i] == of_many:
                yield text, key, tie, anchor[i], int(first[i]), int(last[i])


def _sent_pieces(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for text, key, tie, anchor, first, last in found:
        parts.append((anchor, key, tie, first, text[first : last + WIDTH]))
        size += last - first + WIDTH
        if size >= 8 << 20:
            yield _pieces(parts)
            parts, size = [], 0
    if parts:
        yield _pieces(parts)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "key", "tie", "first", "piece"])


def _sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of one shard, as (key, tie, first start, last start)."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    key, tie, first = (table[n].to_numpy() for n in ("key", "tie", "first"))
    pieces = [p for chunk in table["piece"].chunks for p in chunk.to_pylist()]
    lengths = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no byte of UTF-8
    del tables, table, pieces
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    repeated = np.zeros(len(text), bool)

    def judge(positions: np.ndarray, run: np.ndarray) -> None:
        owner = np.searchsorted(begins, positions, "right") - 1
        inside = positions - begins[owner] + WIDTH <= lengths[owner]
        positions, run, owner = positions[inside], run[inside], owner[inside]
        start = first[owner] + positions - begins[owner]
        order = np.lexsort((start, tie[owner], key[owner], run))
        earliest = np.ones(len(order), bool)
        earliest[1:] = run[order][1:] != run[order][:-1]
        # the same place sent twice is one string
        again = np.zeros(len(order), bool)
        for c in (run, key[owner], tie[owner], start):
            c = c[order]
            again[1:] |= c[1:] != c[:-1]
        repeated[positions[order[~earliest & again]]] = True

    pending_positions, pending_shared, size = [], [], 0
    for positions, shared in SuffixSorter(text, WIDTH).descending():
        if size >= 1 << 18:
            # a run ends before the first suffix that shares less with the one before it
            cut = int(np.argmax(shared < WIDTH)) if (shared < WIDTH).any() else len(shared)
            pending_positions.append(positions[:cut])
            pending_shared.append(shared[:cut])
            positions, shared = positions[cut:], shared[cut:]
            if len(positions):
                _runs(np.concatenate(pending_positions), np.concatenate(pending_shared), judge)
                pending_positions, pending_shared, size = [], [], 0
        pending_positions.append(positions)
        pending_shared.append(shared)
        size += len(positions)
    if pending_positions:
        _runs(np.concatenate(pending_positions), np.concatenate(pending_shared), judge)
    found = np.flatnonzero(repeated)
    if not len(found):
        return
    owner = np.searchsorted(begins, found, "right") - 1
    start = first[owner] + found - begins[owner]
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found) != 1) | (owner[1:] != owner[:-1])
    head, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(found)) - 1
    yield pa.RecordBatch.from_arrays(
        [pa.array(key[owner[head]]), pa.array(tie[owner[head]]), pa.array(start[head]), pa.array(start[tail])], ["key", "tie", "first", "last"]
    )


def _runs(positions: np.ndarray, shared: np.ndarray, judge: Callable[[np.ndarray, np.ndarray], None]) -> None:
    run = np.cumsum(shared < WIDTH)
    several = np.bincount(run)[run] > 1
    if several.any():
        judge(positions[several], run[several])


def covered(firsts: np.ndarray, lasts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans [begin, end) of bytes under strings that start from firsts[i] to lasts[i]."""
    order = np.argsort(firsts, kind="stable")
    begin, end = firsts[order], np.maximum.accumulate(lasts[order] + WIDTH)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(begin)) - 1
    return list(zip(begin[heads].tolist(), end[tails].tolist()))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` (the key as it is), ``key`` (null: the last of all), ``tie``, ``text``."""
    plain = F.coalesce(df[text], F.lit(""))
    return df.select(df[key].alias("id"), F.coalesce(df[key].cast("long"), F.lit(LAST)).alias("key"), F.xxhash64(plain).alias("tie"), plain.alias("text"))


RANGES = "key long, tie long, first long, last long"
PIECES = "anchor long, key long, tie long, first long, piece binary"


def _judged(rows: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Ranges of strings that are repeats, and rows that the anchor alone doesn't settle."""
    order = ["anchor", "stretch", F.col("place").bitwiseAND(SHAPE), "key", "tie", "place"]
    told = rows.repartition("anchor").sortWithinPartitions(*order).mapInArrow(_judge, f"{SCHEMA}, open boolean")
    judged = space.keep(told, "judged")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first, last = _unpack(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(first), pa.array(last)], ["key", "tie", "first", "last"])

    return judged.where(~F.col("open")).select("place", "key", "tie").mapInArrow(unpack, RANGES), judged.where("open")


def find_repeats(docs: DataFrame, space: Workspace, most: int = MOST_CLASSES) -> DataFrame:
    """``key``, ``tie``, ``first``, ``last``: starts of repeated strings, from ``keyed`` rows."""
    source = docs.select("key", "tie", "text")
    found, unsure = _judged(source.mapInArrow(_stretch_rows, SCHEMA), space)
    classes = unsure.groupBy("anchor").agg(F.count("*").alias("n"))
    total, widest = classes.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return found
    shards = max(1, total * (WIDTH + STARTS // 2) // SHARD_BYTES)
    if total > MOST_FILTERED:
        opened = _with_open(source, unsure, classes, most)

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _sent_pieces(_opened(batch, False))

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _single_strings(_opened(batch, True))

        texts = opened.mapInArrow(pieces, PIECES)
        if widest > most:
            found = found.unionByName(_judged(opened.mapInArrow(strings, SCHEMA), space)[0])
    else:
        wanted, many = _filter_of(unsure, whole=True), None
        if widest > most:
            large = classes.where(F.col("n") > most).select("anchor", *[F.lit(0).cast("long").alias(c) for c in ("place", "key", "tie")])
            many = _filter_of(large, whole=False)
            found = found.unionByName(_judged(_strings_of(source, wanted, many), space)[0])
        texts = _texts_of(source, wanted, many)
    return found.unionByName(texts.repartition(shards, "anchor").mapInArrow(_sort_shard, RANGES))


def cut(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_CLASSES) -> DataFrame:
    """``id``, ``kept`` (the remaining bytes), ``n_bytes``, ``spans`` (begin, end) of every row."""
    space = Workspace(df.sparkSession, "substrings")
    docs = keyed(df, key, text)
    found = find_repeats(docs, space, most).groupBy("key", "tie").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = docs.join(found, ["key", "tie"], "left").select("id", "text", "found.first", "found.last")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept, sizes, spans = [], [], []
            for data, first, last in zip(bytes_of(batch.column(1)), batch.column(2), batch.column(3)):
                own = covered(first.values.to_numpy(), last.values.to_numpy()) if first.is_valid else []
                parts, at = [], 0
                for begin, end in own:
                    parts.append(data[at:begin])
                    at = end
                kept.append(b"".join([*parts, data[at:]]))
                sizes.append(len(data))
                spans.append([{"begin": b, "end": e} for b, e in own])
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, span)], ["id", "kept", "n_bytes", "spans"]
            )

        return work

    kind = joined.schema["id"].dataType.simpleString()
    return per_batch(joined, make, f"id {kind}, kept binary, n_bytes long, spans array<struct<begin: long, end: long>>")


def digest_cut(df: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    rows = cut(df.select("doc_id", "text"), most=most)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
