"""Url rules against a plain version, globs against regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inversia.llm import urlrules
from inversia.llm.queries import ORACLES, QUERIES
from inversia.llm.urlrules import ALLOW, BLOCK, RULES, Automaton, Rule, RuleBook
from tests.llm.messy import FOLDER
from tests.oracle import connect, difference


def plain(url, rules=RULES, default=ALLOW):
    """Split by hand, rules tried one by one."""
    rest = (url or "").partition("://")
    host = path = ""
    if rest[1]:
        cut = next((i for i, c in enumerate(rest[2]) if c in "/?#"), len(rest[2]))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[2][:cut])
        path = re.split("[?#]", rest[2][cut:])[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name)) if fit else None
    return host, path, best and best.name, best.verdict if best else default


ODD = [
    None, "", "no scheme", "http://", "http:///", "://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/", "https://example.com/en", "https://notexample.com/en/x",
    "https://a.www.example.com/en/x?y=/es/", "http://x.net/es/1#top", "http://net/fr/", "http://.net/fr/", "http://x.net/EN/", "http://evil.org/a.com/", "http://x.org/?u=http://a.com/",
    "http://x.com", "http://x.com?q", "http://x.com/\n/é?", "http://bücher.COM/ß", "http://É.example.com/en/中", "a://b://c.com/", "http://x.net/es/" + "y" * 5000, "http://" + "z" * 3000 + ".com/",
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i if i % 5 else None, u, "x", "y") for i, u in enumerate(ODD + ODD[5:8])], "page_id long, url string, rule string, host string").repartition(3)
    got = sorted((tuple(r) for r in urlrules.judge_urls(df).collect()), key=repr)
    want = sorted(((r.page_id, *plain(r.url)) for r in df.collect()), key=repr)
    assert got == want
    kept = urlrules.drop_blocked(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in df.collect() if plain(r.url)[3] == ALLOW)
    assert urlrules.judge_urls(df.limit(0)).collect() == []


def test_globs_mean_what_regular_expressions_mean():
    rng = random.Random(3)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", ".", "é", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 40))]
        texts = ["".join(rng.choice("ab/.é中") for _ in range(rng.randrange(12))) for _ in range(80)]
        patterns = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g))) for g in globs]
        want = [next((i for i, p in enumerate(patterns) if p.fullmatch(t)), -1) for t in texts]
        encoded = [t.encode() for t in texts]
        ends = np.cumsum([len(e) for e in encoded])
        data = np.frombuffer(b"".join(encoded) + b"x", np.uint8)
        assert Automaton(globs).first_fit(data, ends - [len(e) for e in encoded], ends).tolist() == want


@pytest.mark.parametrize("most_words", [1, 2, urlrules.MOST_WORDS])
def test_many_rules_over_many_words(most_words):
    rng = random.Random(7)
    rules = [Rule(f"{rng.choice('abc')}{i % 17}.{rng.choice(['org', 'net'])}", rng.choice(["/", "/a/", "/a/b"]), rng.choice([ALLOW, BLOCK])) for i in range(150)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"http://{rng.choice(['', 'x.', 'y.x.'])}{rng.choice('abc')}{rng.randrange(17)}.{rng.choice(['org', 'net'])}{rng.choice(['', '/', '/a/', '/a/bc', '/q'])}" for _ in range(400)]
    book = RuleBook(rules, most_words)
    won = book.winners(pa.array([plain(u)[0] + plain(u)[1] for u in urls]).slice(0))
    assert [book.rules[i].name if i >= 0 else None for i in won] == [plain(u, rules)[2] for u in urls]
    part = pa.array([plain(u)[0] + plain(u)[1] for u in urls]).slice(100, 50)  # an offset into a longer column
    assert book.winners(part).tolist() == won[100:150].tolist()


def test_query_against_sql(spark):
    assert difference(QUERIES["op12_url_filters"](spark, FOLDER), connect(FOLDER), ORACLES["op12_url_filters"]) is None
