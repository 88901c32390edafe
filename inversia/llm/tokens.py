"""Exact token counts at every prefix of a text, for a byte-pair model of pieces.

A byte-pair encoder never merges across two characters that no piece holds side by side. With
this kind of model no piece has a space mark after another character, nor a line end anywhere, so
a text falls into segments (a run of space marks and what follows it) that are encoded apart, and
the count at a prefix is the sum over whole segments plus the count at a prefix of one segment.

Within a segment a recurrence over prefixes gives both the last piece and the count: the last
piece of prefix i is the one piece t ending at i that the encoder leaves beside the last piece of
prefix i - len(t); the count is one more than there. Whether two pieces are left side by side is
asked of the library once per pair. Characters that are no piece count as their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from inversia.llm.workspace import per_batch

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Segments remembered by a worker; the tables of longer ones and of any beyond are computed anew.
REMEMBERED, LONGEST_REMEMBERED = 800_000, 48


class PrefixCounter:
    """Token counts at prefixes for the model file at ``path`` (begin and end marks not counted)."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self._pieces = frozenset(model.id_to_piece(i) for i in ordinary)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self._pieces):
            raise ValueError("pieces that span words or lines: the text can't be cut into segments")
        # pieces by their characters from last to first; "" marks the end of a piece
        self._backwards: dict = {}
        for piece in self._pieces:
            node = self._backwards
            for character in reversed(piece):
                node = node.setdefault(character, {})
            node[""] = piece
        self._beside: dict[tuple[str, str], bool] = {}
        self._counts: dict[str, int] = {"": 0}

    def _left_apart(self, a: str, b: str) -> bool:
        # after a line end, which is two tokens with the mark the library puts in front
        found = self._model.encode("\n" + a + b, out_type=str)[2:]
        apart = self._beside[a, b] = found == [a, b]
        return apart

    def table(self, segment: str) -> list[int]:
        """Counts at the prefixes of one segment, the empty one first."""
        last: list[str] = [""] * (len(segment) + 1)
        counts = [0] * (len(segment) + 1)
        beside, left_apart = self._beside, self._left_apart
        for end in range(1, len(segment) + 1):
            node, start, ending = self._backwards, end, []
            while start and (node := node.get(segment[start - 1])):
                start -= 1
                if "" in node:
                    ending.append((start, node[""]))
            for start, piece in reversed(ending):
                before = last[start]
                if not before or beside.get((before, piece)) or ((before, piece) not in beside and left_apart(before, piece)):
                    last[end], counts[end] = piece, counts[start] + 1
                    break
            else:  # in bytes; "" as last piece: nothing merges with it
                counts[end] = counts[end - 1] + len(segment[end - 1].encode())
        return counts

    def _count(self, segment: str) -> int:
        known = self._counts.get(segment)
        if known is None:
            known = self.table(segment)[-1]
            if len(segment) <= LONGEST_REMEMBERED and len(self._counts) < REMEMBERED:
                self._counts[segment] = known
        return known

    @staticmethod
    def _of_line(line: str) -> list[str]:
        head, *rest = line.split(MARK)
        out, marks = ([head] if head else []), ""
        for part in rest:
            marks += MARK
            if part:
                out.append(marks + part)
                marks = ""
        return [*out, marks] if marks else out

    @classmethod
    def segments(cls, text: str) -> list[str]:
        """The text as the model sees it (a space mark in front), cut where nothing merges."""
        if not text:
            return []
        first, *lines = (MARK + text.replace(" ", MARK)).split("\n")
        return cls._of_line(first) + [s for line in lines for s in ("\n", *cls._of_line(line))]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(map(self._count, self.segments(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for every i from 0 to its length."""
        if not text:
            return [0]
        out, base = [0], 0
        for k, segment in enumerate(self.segments(text)):
            table = self.table(segment)
            # the first mark is the library's own: the empty prefix of a text has no tokens
            out += [base + n for n in (table[2:] if k == 0 else table[1:])]
            base += table[-1]
        return out

    def fits(self, text: str, budget: int) -> int:
        """The longest prefix, in code points, with at most ``budget`` tokens at it and at every
        shorter prefix."""
        worst = list(accumulate(self.prefix_counts(text), max))
        low, high = 0, len(worst) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if worst[middle] <= budget else (low, middle - 1)
        return low


@cache
def counter(path: str | None) -> PrefixCounter:
    """One per worker process, which tasks share: what it remembers is the same for every text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return PrefixCounter(path)


def count_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row, whole texts, one row each.

    Null and empty texts have no bytes and no tokens. Null and repeated keys stay as they are.
    ``path``: the model file, by default the public one, looked up on each worker."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = counter(path).count

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [count(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return work

    narrow = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return per_batch(narrow, make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", key)


def truncate(df: DataFrame, budget: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``text`` cut to the longest prefix within ``budget`` tokens; null texts stay null."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        fits = counter(path).fits

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = [None if t is None else t[: fits(t, budget)] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"])

        return work

    narrow = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return per_batch(narrow, make, f"doc_id {kind}, text string").withColumnsRenamed({"doc_id": key, "text": text})
