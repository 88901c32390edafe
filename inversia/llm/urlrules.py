"""Url rules as globs, matched all at once by a bit-parallel automaton.

A rule is a host and the start of a path; it fits that host and every subdomain. It becomes two
globs over the canonical url (host, then path): ``host/path**`` and ``*.host/path**``. In a glob
``*`` stands for any run of characters but ``/``, ``**`` for any run, ``?`` for one character but
``/``; everything else stands for itself.

All globs lie side by side in one row of bits, a bit for each place a glob may have reached. A
literal moves a bit to the next place, a wildcard lets it stay. So a byte of a url is one step for
every glob: shift by one and keep the places that the byte leads into, then add those it may stay
in. The bits take as many 64-bit words as they need; many urls step at the same time in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 64-bit words of one automaton (more rules: several automata), and of all states held at once.
MOST_WORDS, HELD = 1 << 10, 1 << 20
CONTINUES = np.array([0x80 <= b < 0xC0 for b in range(256)])


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", ALLOW),
    Rule("example.com", "/en/", BLOCK),
    Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK),
    Rule("net", "/fr/", BLOCK),
)


def globs_of(rule: Rule) -> list[str]:
    """The globs of a rule's host and of its subdomains; wildcards in its parts keep their meaning."""
    return [f"{rule.name}**", f"*.{rule.name}**"]


def _places(glob: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place of a glob from its start on: the bytes that lead into it, the bytes it may
    stay at."""
    none, every = np.zeros(256, bool), np.ones(256, bool)
    not_slash = every.copy()
    not_slash[ord("/")] = False
    places = [(none.copy(), none.copy())]
    at = 0
    while at < len(glob):
        if glob.startswith("**", at):
            places[-1] = (places[-1][0], every.copy())
            at += 2
        elif glob[at] == "*":
            places[-1] = (places[-1][0], places[-1][1] | not_slash)
            at += 1
        elif glob[at] == "?":
            # the further bytes of a character stay where its first byte led to
            places.append((not_slash & ~CONTINUES, CONTINUES.copy()))
            at += 1
        else:
            for byte in glob[at].encode():
                only = none.copy()
                only[byte] = True
                places.append((only, none.copy()))
            at += 1
    return places


class Automaton:
    """Globs in order of rank: the first of them that fits a url wins."""

    def __init__(self, globs: Sequence[str]):
        places = [_places(g) for g in globs]
        bits = sum(map(len, places))
        self.words = max(1, -(-bits // 64))
        enter, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        first, last, over = (np.zeros((1, self.words * 64), bool) for _ in range(3))
        ends, at = [], 0
        for of_glob in places:
            first[0, at] = True
            for into, loop in of_glob:
                enter[:, at], stay[:, at] = into, loop
                at += 1
            ends.append(at - 1)
            last[0, at - 1] = True
            over[0, at - 1] = of_glob[-1][1].all()
        pack = lambda table: np.packbits(table, axis=1, bitorder="little").view(np.uint64)
        self.enter, self.stay, self.first = pack(enter), pack(stay), pack(first)[0]
        #: places that nothing leaves any more: the end of a glob that goes on for ever
        self.over = pack(over)[0]
        self.end_word, self.end_bit = np.array(ends, np.int64) // 64, (np.array(ends, np.int64) % 64).astype(np.uint64)

    def first_fit(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each url (bytes ``starts`` to ``ends`` of ``data``) the first glob that fits it, or -1."""
        out = np.full(len(starts), -1, np.int64)
        slice_of = max(1, HELD // self.words)
        for a in range(0, len(starts), slice_of):
            out[a : a + slice_of] = self._fit(data, starts[a : a + slice_of], ends[a : a + slice_of])
        return out

    def _fit(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        reached = np.zeros((len(starts), self.words), np.uint64)
        live, at, state = np.arange(len(starts)), starts.copy(), np.repeat(self.first[None], len(starts), 0)
        one, top = np.uint64(1), np.uint64(63)
        while len(live):
            # a url leaves when it is read, or when no further byte can change where its globs are
            done = (at >= ends[live]) | ((state & ~self.over) == 0).all(1)
            if done.any():
                reached[live[done]] = state[done]
                live, at, state = live[~done], at[~done], state[~done]
                if not len(live):
                    break
            byte = data[at]
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = (moved & self.enter[byte]) | (state & self.stay[byte])
            at += 1
        fits = (reached[:, self.end_word] >> self.end_bit) & one
        return np.where(fits.any(1), fits.argmax(1), -1) if len(self.end_word) else np.full(len(starts), -1)


class RuleBook:
    """Rules by rank (longest first, then as given), as automata of at most ``MOST_WORDS`` words."""

    def __init__(self, rules: Sequence[Rule], most_words: int = MOST_WORDS):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        self._automata: list[tuple[Automaton, np.ndarray]] = []
        part, owners, bits = [], [], 0
        for i, rule in enumerate(self.rules):
            globs = globs_of(rule)
            more = sum(len(_places(g)) for g in globs)
            if part and bits + more > most_words * 64:
                self._automata.append((Automaton(part), np.array(owners)))
                part, owners, bits = [], [], 0
            part, owners, bits = part + globs, owners + [i] * len(globs), bits + more
        if part:
            self._automata.append((Automaton(part), np.array(owners)))

    def winners(self, urls: pa.Array) -> np.ndarray:
        """For each canonical url the index of the longest rule that fits it, or -1."""
        column = urls.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        body = column.buffers()[2] if len(column) else None
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(1, np.uint8)
        out = np.full(len(column), -1, np.int64)
        for automaton, owners in self._automata:  # longer rules come first
            open_ = np.flatnonzero(out < 0)
            fit = automaton.first_fit(data, offsets[:-1][open_], offsets[1:][open_])
            out[open_[fit >= 0]] = owners[fit[fit >= 0]]
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lowered: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; the path:
    from there up to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    known = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def judge_urls(df: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """``key, host, path, rule, verdict`` of every row.

    ``rule``: host and path of the longest rule that fits, null if none does; the ``verdict`` is the
    rule's, else ``default`` (a list of rules says nothing of other urls; they pass). Of equally
    long rules that fit the one given first counts. Null and empty urls have an empty host and path.
    Null and repeated keys stay; an empty table gives an empty one. Other columns aren't read, so
    their names don't matter. One pass without a shuffle; the rules go to the tasks with the code."""
    host, path = host_and_path(df[url])
    narrow = df.select(df[key].alias("key"), host.alias("host"), path.alias("path")).withColumn("whole", F.concat("host", "path"))
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = RuleBook(rules)
        names = pa.array([r.name for r in book.rules], pa.string())
        verdicts = pa.array([r.verdict for r in book.rules] + [default], pa.string())
        for batch in batches:
            won = book.winners(batch.column(3))
            place = pa.array(won, mask=won < 0)
            verdict = verdicts.take(pa.array(np.where(won < 0, len(book.rules), won)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names.take(place), verdict], ["key", "host", "path", "rule", "verdict"])

    kind = narrow.schema["key"].dataType.simpleString()
    found = narrow.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string")
    return found.withColumnRenamed("key", key)


def drop_blocked(df: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", default: str = ALLOW) -> DataFrame:
    """The rows whose url isn't blocked, with all their columns and names."""
    host, path = host_and_path(df[url])
    rules = tuple(rules)

    @F.arrow_udf("boolean")
    def blocked(urls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        book = RuleBook(rules)
        blocks = np.array([r.verdict == BLOCK for r in book.rules] + [default == BLOCK])
        for batch in urls:
            yield pa.array(blocks[book.winners(batch)])  # no rule is -1, the last entry

    return df.where(~blocked(F.concat(host, path)))
