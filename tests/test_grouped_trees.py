"""Trees of many groups grown together, against trees grown one by one, and their exact Shapley values."""

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inversia.operators import grouped_trees, tree_shapley
from inversia.operators.grouped_trees import Growth

FEATURES = ["a", "b", "c", "d"]


def table(spark, rows=400, seed=3):
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        site = rng.choice(["hot", "hot", "hot", "x", None])
        a, b, c, d = (rng.choice([None, float("nan"), *range(9)]) if rng.random() < 0.2 else rng.randrange(9) for _ in range(4))
        z = [0 if v is None or v != v else v for v in (a, b, c, d)]
        y = None if rng.random() < 0.1 else (z[0] > 4) * 10.0 + z[1] * (1 if site == "hot" else -1) + rng.random()
        data.append((site, i, *[None if v is None else float(v) for v in (a, b, c, d)], y, "kept"))
    data.append(("empty", 10**6, 1.0, 2.0, 3.0, 4.0, None, "kept"))
    return spark.createDataFrame(data, "site string, id long, a double, b double, c double, d double, y double, _extra string").repartition(4)


def plain_boosting(rows, growth):
    """One group's predictions: rows of (features, label or None), every different value an edge."""
    value = lambda v: -math.inf if v is None or v != v else v
    rows = [([value(v) for v in x], y) for x, y in rows]
    known = [y for _, y in rows if y is not None]
    if not known:
        return [None] * len(rows)
    p = [sum(known) / len(known)] * len(rows)
    part = lambda g, h: g * g / (h + growth.l2) if h + growth.l2 else 0.0

    def grow(members, everyone, depth):
        g, h = sum(p[i] - rows[i][1] for i in members), len(members)
        best = None
        for f in range(len(FEATURES)) if depth else ():
            for cut in sorted({rows[i][0][f] for i in members})[:-1]:
                left = [i for i in members if rows[i][0][f] <= cut]
                gl, hl = sum(p[i] - rows[i][1] for i in left), len(left)
                gain = part(gl, hl) + part(g - gl, h - hl) - part(g, h)
                if min(hl, h - hl) >= growth.least and gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-7)):
                    best = (gain, f, cut)
        if best is None:
            return {i: -g / (h + growth.l2) * growth.rate if h + growth.l2 else 0.0 for i in everyone}
        _, f, cut = best
        out = {}
        for side in (True, False):
            out |= grow([i for i in members if (rows[i][0][f] <= cut) == side], [i for i in everyone if (rows[i][0][f] <= cut) == side], depth - 1)
        return out

    for _ in range(growth.rounds):
        step = grow([i for i, (_, y) in enumerate(rows) if y is not None], range(len(rows)), growth.depth)
        p = [v + step[i] for i, v in enumerate(p)]
    return p


@pytest.mark.parametrize("sent", [True, False])
def test_equal_to_trees_grown_one_by_one(spark, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(grouped_trees, "MOST_SENT", 0)
    growth = Growth(rounds=3, depth=3, rate=0.5, l2=1.0, least=2, bits=52)
    df = table(spark)
    model, out = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=growth)
    assert set(out.columns) == {*df.columns, "prediction"} and out.count() == df.count()
    got = {r.id: r.prediction for r in out.collect()}
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.site].append(r)
    for members in groups.values():
        for r, want in zip(members, plain_boosting([([r[f] for f in FEATURES], r.y) for r in members], growth)):
            assert got[r.id] is None if want is None else math.isclose(got[r.id], want, abs_tol=1e-6)
    again = {r.id: (r.prediction, r.later) for r in model.predict(out, "later").collect()}
    assert all((a is None and b is None) or math.isclose(a, b, abs_tol=1e-9) for a, b in again.values())


def test_draws_repeat_and_losses_learn(spark):
    df = table(spark).withColumn("yes", (F.col("y") > 6).cast("int"))
    growth = Growth(rounds=4, depth=2, rate=0.5, rows=0.7, columns=0.5)
    first, second = (sorted(grouped_trees.fit_boosted(d, ["site"], FEATURES, "y", ["id"], growth=growth)[1].select("id", F.round("prediction", 9)).collect()) for d in (df, df.repartition(7)))
    assert first == second
    _, out = grouped_trees.fit_boosted(df, ["site"], FEATURES, "yes", ["id"], growth=Growth(rounds=4, depth=2, rate=0.5, least=0.1, loss="logistic"))
    known = [r for r in out.collect() if r.yes is not None]
    assert all(0 < r.prediction < 1 for r in known)
    assert sum((r.prediction > 0.5) == r.yes for r in known) > 0.8 * len(known)
    with pytest.raises(ValueError):
        grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=Growth(loss="other"))


def test_forest_beats_the_mean_and_ranks_signal(spark):
    df = table(spark, 800).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0)
    model, out = grouped_trees.fit_forests(df, ["site"], [*FEATURES, "noise"], "y", ["id"], trees=8, growth=Growth(depth=5, least=2, l2=0.0))
    rows = [r for r in out.collect() if r.y is not None]
    mean = sum(r.y for r in rows) / len(rows)
    assert sum((r.prediction - r.y) ** 2 for r in rows) < 0.3 * sum((mean - r.y) ** 2 for r in rows)
    shares = {(r.site, r.feature): r.importance for r in model.importance().collect()}
    assert all(shares[s, "b"] > 3 * shares[s, "noise"] for s in ("hot", "x"))
    assert all(math.isclose(sum(v for (s, _), v in shares.items() if s == site), 1) for site in ("hot", "x"))
    later = model.predict(out, "later").where("prediction IS NOT NULL")
    assert later.agg(F.max(F.abs(F.col("later") - F.col("prediction")))).first()[0] < 1e-9


def test_many_values_have_few_bins(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("site"), (F.col("id") * 0.37).alias("v"), F.lit(0.0).alias("flat"), F.lit(float("inf")).alias("w"))
    edges = {r.site: r.edges for r in grouped_trees.bin_edges(df, ["site"], ["v", "flat", "w"], 16, 8).collect()}
    for v, flat, w in edges.values():
        assert 10 <= len(v) <= 16 and flat == [] and w == [] and v == sorted(v)
        assert max(b - a for a, b in zip([0, *v], [*v, 1850])) < 250


def test_no_rows(spark):
    df = table(spark).where("false")
    model, out = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=Growth(rounds=2, depth=2))
    assert out.collect() == [] and model.importance().collect() == [] and model.predict(df).collect() == []


def plain_shapley(model, rows):
    """All subsets: unknown features follow both branches by their share of the training rows."""
    trees, base = defaultdict(dict), {r.site: r.base for r in model.base.collect()}
    for r in model.trees.collect():
        trees[r.site, r.tree][r.node] = r

    def value(nodes, node, x, known):
        r = nodes[node]
        if r.feature is None:
            return r.value
        if r.feature in known:
            v = x[r.feature]
            return value(nodes, node * 2 + int(v is not None and v == v and v > r.threshold), x, known)
        return sum(nodes[node * 2 + k].cover / r.cover * value(nodes, node * 2 + k, x, known) for k in (0, 1))

    out = {}
    for r in rows:
        if r.site not in base:
            continue
        x = {f: r[f] for f in FEATURES}
        v = {s: sum(value(n, 1, x, s) for (site, _), n in trees.items() if site == r.site) for k in range(5) for s in itertools.combinations(FEATURES, k)}
        for f in FEATURES:
            rest = [g for g in FEATURES if g != f]
            phi = 0.0
            for k in range(4):
                for s in itertools.combinations(rest, k):
                    with_f = tuple(g for g in FEATURES if g in s or g == f)
                    phi += math.factorial(k) * math.factorial(3 - k) / 24 * (v[with_f] - v[s])
            out[r.id, f] = (phi, base[r.site] + v[()])
    return out


def test_shapley_values_equal_all_subsets_and_add_up(spark, monkeypatch):
    monkeypatch.setattr(tree_shapley, "TREES_AT_ONCE", 2)
    df = table(spark, 150)
    model, out = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=Growth(rounds=3, depth=4, rate=0.5, least=2))
    got = {(r.id, r.feature): (r.phi, r.expected) for r in tree_shapley.tree_shapley(model, df, ["id"]).collect()}
    want = plain_shapley(model, df.collect())
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in want for a, b in zip(got[k], want[k]))
    for r in out.collect():
        if r.prediction is not None:
            assert math.isclose(r.prediction, got[r.id, "a"][1] + sum(got[r.id, f][0] for f in FEATURES), abs_tol=1e-9)


def test_shapley_values_of_a_forest(spark):
    df = table(spark, 120)
    model, out = grouped_trees.fit_forests(df, ["site"], FEATURES, "y", ["id"], trees=3, growth=Growth(depth=3, least=2, l2=0.0))
    phi = tree_shapley.tree_shapley(model, df, ["id"])
    total = phi.groupBy("id").agg((F.sum("phi") + F.first("expected")).alias("total")).join(out, "id")
    assert total.agg(F.max(F.abs(F.col("total") - F.col("prediction")))).first()[0] < 1e-9
    ranks = tree_shapley.shapley_ranks(phi).collect()
    assert sorted(r["rank"] for r in ranks) == [1, 2, 3, 4] and {r.feature for r in ranks if r["rank"] <= 2} == {"a", "b"}


def test_large_groups_and_variants_grow_the_same_trees(spark, monkeypatch):
    df = table(spark)
    sizes = {"p1": Growth(rounds=1, depth=2, rate=0.5, least=2, bins=4, bits=52), "p2": Growth(rounds=2, depth=1, rate=0.5, l2=0.0, bins=4, bits=52)}
    alone = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=sizes["p2"])[1]
    # the site of two thirds of the rows sends sums, the others meet in a task
    monkeypatch.setattr(grouped_trees, "MOST_CELLS", 600)
    models, out = grouped_trees.fit_variants(df, ["site"], FEATURES, "y", ["id"], None, sizes)
    assert set(out.columns) == {*df.columns, *sizes} and set(models) == set(sizes)
    both = out.join(alone.select("id", "prediction"), "id")
    assert both.where("abs(p2 - prediction) < 1e-9 OR (p2 IS NULL AND prediction IS NULL)").count() == df.count()
    assert both.where("abs(p1 - p2) > 1e-3").count() > 0


def written(monkeypatch, module):
    """Names and tables that the module writes from now on."""
    names, tables, write = [], [], module.staged

    def staged(df, name):
        names.append(name)
        tables.append(write(df, name))
        return tables[-1]

    monkeypatch.setattr(module, "staged", staged)
    return names, tables


def test_shapley_values_are_made_once_a_cell(spark, monkeypatch):
    df = table(spark)
    model, _ = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=Growth(rounds=1, depth=1, rate=1.0, l2=0.0))
    names, tables = written(monkeypatch, tree_shapley)
    found = tree_shapley.tree_shapley(model, df, ["id"])
    assert found.count() == 400 * len(FEATURES)
    # one cut a group: two cells of it, one feature of a cell has a value
    assert max(t.count() for n, t in zip(names, tables) if n == "phi") <= 2 * 3


def test_the_last_round_is_not_written(spark, monkeypatch):
    df = table(spark)
    names, _ = written(monkeypatch, grouped_trees)
    _, out = grouped_trees.fit_boosted(df, ["site"], FEATURES, "y", ["id"], growth=Growth(rounds=3, depth=1))
    assert names.count("round") == 2
    assert out.where("prediction IS NOT NULL").count() == 400 and "_extra" in out.columns


def test_a_row_adds_up_its_trees_without_a_shuffle(spark):
    df = table(spark)
    _, out = grouped_trees.fit_forests(df, ["site"], FEATURES, "y", ["id"], trees=3, growth=Growth(depth=2, least=2.0, l2=0.0))
    assert out.where("prediction IS NOT NULL").count() == 400
    assert "Exchange hashpartitioning(_row" not in out._jdf.queryExecution().executedPlan().toString()
