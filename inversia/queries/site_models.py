"""Queries on models that every group has for itself, and on exact Shapley values of trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inversia.operators import grouped_trees, tree_shapley
from inversia.operators.grouped_trees import Growth
from inversia.operators.windows import add_targets
from inversia.plans import site_models
from inversia.queries.views import LINE_KEYS, SITE, SPEC, TIME, Query, lines, r, rounded, station, with_station
from inversia.session import staged

FEATURES = ("l_quantity", "l_discount", "l_tax")
# trees of one cut, an edge at every value: small enough to grow again in SQL
STUMPS = Growth(rounds=2, depth=1, rate=0.5, l2=3.0, bins=256, bits=52)


def stump_ctes(group: str, features: Sequence[str], growth: Growth, start: str = "r0") -> str:
    """CTEs ``r1``, ``r2``, ... like ``start`` (group columns, features, y, is_train, p) with p after
    each round of one-cut trees, and ``m0``, ``m1``, ... with the cuts."""
    parts = []
    l2, numbers, values = f"{growth.l2}e0", list(range(len(features))), ", ".join(features)
    for k in range(growth.rounds):
        source = start if k == 0 else f"r{k}"
        gain = f"gl * gl / (hl + {l2}) + (ga - gl) * (ga - gl) / (ha - hl + {l2}) - ga * ga / (ha + {l2})"
        chosen = "CASE b.f " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features)) + " END"
        leaf = f"CASE WHEN b IS NULL THEN -ga / (ha + {l2}) WHEN {chosen} <= b.v THEN -b.gl / (b.hl + {l2}) ELSE -(ga - b.gl) / (ha - b.hl + {l2}) END"
        parts += [
            f"u{k} AS (SELECT {group}, f, v, sum(p - y) AS g, count(*) AS h FROM (SELECT {group}, p, y, unnest({numbers}) AS f, unnest([{values}]) AS v FROM {source} WHERE is_train) GROUP BY ALL)",
            f"w{k} AS (SELECT *, sum(g) OVER (PARTITION BY {group}, f ORDER BY v) AS gl, sum(h) OVER (PARTITION BY {group}, f ORDER BY v) AS hl, "
            f"sum(g) OVER (PARTITION BY {group}, f) AS ga, sum(h) OVER (PARTITION BY {group}, f) AS ha FROM u{k})",
            f"g{k} AS (SELECT *, {gain} AS gain FROM w{k})",
            f"b{k} AS (SELECT {group}, arg_max(struct_pack(f := f, v := v, gain := gain, gl := gl, hl := hl), (cast(gain AS float), -f, -v)) AS b FROM g{k} "
            f"WHERE hl >= {growth.least} AND ha - hl >= {growth.least} AND gain > 0 GROUP BY {group})",
            f"a{k} AS (SELECT {group}, max(ga) AS ga, max(ha) AS ha FROM w{k} WHERE f = 0 GROUP BY {group})",
            f"m{k} AS (SELECT * FROM a{k} LEFT JOIN b{k} USING ({group}))",
            f"r{k + 1} AS (SELECT s.* EXCLUDE (p), s.p + coalesce(({leaf}) * {growth.rate}e0, 0) AS p FROM {source} s LEFT JOIN m{k} USING ({group}))",
        ]
    return ", ".join(parts)


# -- second-order boosting of three groups -----------------------------------------------------------
def _boosted_lines(spark, folder, growth=STUMPS):
    return grouped_trees.fit_boosted(lines(spark, folder).select(*LINE_KEYS, *FEATURES, "l_extendedprice"), ["l_returnflag"], FEATURES, "l_extendedprice", LINE_KEYS, growth=growth)


def _newton(spark, folder):
    """Both cuts of every group: feature, threshold, gain (relative), rows and leaf values."""
    model, _ = _boosted_lines(spark, folder)
    t = model.trees
    at = lambda node, c: F.max(F.when(F.col("node") == node, F.col(c)))
    found = t.groupBy("l_returnflag", "tree").agg(
        at(1, "feature").alias("feature"), at(1, "threshold").alias("threshold"), at(1, "gain").alias("gain"), at(1, "cover").cast("bigint").alias("n"), at(2, "value").alias("below"), at(3, "value").alias("above")
    )
    return found.withColumn("gain", F.col("gain") / 1e6).transform(lambda d: rounded(d, 4))


LINE_START = f"r0 AS (SELECT l_returnflag, {', '.join(FEATURES)}, l_extendedprice AS y, true AS is_train, avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS p FROM lineitem)"
NEWTON_SQL = (
    f"WITH {LINE_START}, {stump_ctes('l_returnflag', FEATURES, STUMPS)} "
    + " UNION ALL ".join(
        f"SELECT l_returnflag, {k} AS tree, ['{FEATURES[0]}', '{FEATURES[1]}', '{FEATURES[2]}'][b.f + 1] AS feature, {r('b.v', 'threshold', 4)}, {r('b.gain / 1e6', 'gain', 4)}, cast(ha AS bigint) AS n, "
        f"{r(f'-b.gl / (b.hl + {STUMPS.l2}e0) * {STUMPS.rate}e0', 'below', 4)}, {r(f'-(ga - b.gl) / (ha - b.hl + {STUMPS.l2}e0) * {STUMPS.rate}e0', 'above', 4)} FROM m{k}"
        for k in range(STUMPS.rounds)
    )
)


def _noise(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(5)), F.lit(100_000)) / 100_000.0


def _learning(spark, folder):
    """Whether deeper trees, drawn and penalized, predict unseen rows of every event type better than the mean."""
    st = station(spark, folder, ["DWPT", "WSPD", "VT05", "PRES"]).withColumn("is_train", F.col("event_id") % 5 != 0).withColumn("noise", _noise("event_id"))
    sizes = Growth(rounds=4, depth=3, rate=0.6, rows=0.8, columns=0.8)
    features = ["VT05", "WSPD", "noise"]
    st = st.select("event_type", "event_id", "is_train", "DWPT", *features)  # a fit writes all columns it is given
    model, out = grouped_trees.fit_boosted(st, ["event_type"], features, "DWPT", ["event_id"], F.col("is_train"), sizes)
    held = out.where("NOT is_train").groupBy("event_type").agg(
        F.count("prediction").alias("predicted"), (F.sqrt(F.avg((F.col("DWPT") - F.col("prediction")) ** 2)) < 0.5 * F.stddev_pop("DWPT")).alias("beats_mean")
    )
    shares = model.importance().groupBy("event_type").agg(F.max_by("feature", "importance").alias("strongest"))
    return held.join(shares, "event_type")


LEARNING_SQL = with_station("SELECT event_type, count(*) AS predicted, true AS beats_mean, 'WSPD' AS strongest FROM st WHERE event_id % 5 = 0 GROUP BY event_type")


# -- forecasts of every site ------------------------------------------------------------------------
SITE_FEATURES = ("WSPD", "PRES", "VT05", "VT90")
SITE_TARGETS = {"next": "VT20_target_1h", "now": "DWPT"}


def _all_sites(spark, folder):
    """Rows predicted, and the error of the undrawn variant, of every site and target."""
    st = add_targets(station(spark, folder, [*SITE_FEATURES, "VT20", "DWPT"]).drop("event_type"), SPEC, ["VT20"], [1])
    found = site_models.forecast_all_sites(st, SPEC, SITE_TARGETS, SITE_FEATURES, False, STUMPS, folds=2)
    counted = found["predictions"].groupBy("site", "target", "model").agg(F.count("prediction").alias("n"))
    scored = counted.join(found["results"], ["site", "target", "model"])
    shares = found["importance"].groupBy("site", "target", "model").agg(F.round(F.sum("importance"), 6).alias("importance"))
    exact = F.when(F.col("model") == "gbt_full", F.col("rmse")).alias("rmse")
    wrong = F.expr("model <> 'gbt_full' AND NOT (rmse >= 0)").alias("wrong")
    best = found["best"].select("site", "target", (F.col("rmse") >= 0).alias("has_best"))
    return rounded(scored.join(shares, ["site", "target", "model"], "left").select("site", "target", "model", "n", exact, wrong, F.when(F.col("model") != "stacked", F.col("importance") <= 1).alias("shares")).join(best, ["site", "target"]), 5)


ALL_SITES_SQL = with_station(
    f", l AS (SELECT {SITE} AS site, {TIME} AS ts, event_id, {', '.join(SITE_FEATURES)}, unnest(['next', 'now']) AS target, "
    f"unnest([lead(VT20) OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id), DWPT]) AS y FROM st), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY site, target ORDER BY ts, event_id) - 1 < floor(count(*) OVER (PARTITION BY site, target) * 0.8e0) AS is_train FROM l WHERE y IS NOT NULL), "
    "r0 AS (SELECT *, avg(y) FILTER (WHERE is_train) OVER (PARTITION BY site, target) AS p FROM k), "
    + stump_ctes("site, target", SITE_FEATURES, STUMPS)
    + f", e AS (SELECT site, target, count(p) AS n, {r('sqrt(avg((y - p) * (y - p)))', 'rmse', 5)} FROM r{STUMPS.rounds} WHERE NOT is_train AND p IS NOT NULL GROUP BY site, target) "
    "SELECT site, target, model, n, CASE WHEN model = 'gbt_full' THEN rmse END AS rmse, false AS wrong, CASE WHEN model <> 'stacked' THEN true END AS shares, true AS has_best "
    "FROM e, (SELECT unnest(['gbt_row_col', 'gbt_col', 'gbt_full', 'stacked']) AS model)"
)


# -- fills of every site ------------------------------------------------------------------------------
def _fill(method, growth, trees=1):
    def run(spark, folder):
        """Cells left as they were, filled and left empty per site, and whether hidden cells came back better than by the mean."""
        st = station(spark, folder, ["TAIR", "DWPT", "WSPD", "PRES"]).drop("event_type")
        hidden = F.col("TAIR").isNotNull() & (F.col("event_id") % 7 == 0)
        masked = staged(st.withColumns({"truth": F.when(hidden, F.col("TAIR")), "TAIR": F.when(~hidden, F.col("TAIR")), "before": F.when(~hidden, F.col("TAIR"))}), "masked")
        out = staged(site_models.fill_all_sites(masked, SPEC, ["TAIR"], method, growth, trees, sensors=["TAIR", "DWPT", "WSPD", "PRES"]), "filled")
        error = lambda p: F.sum((F.col("truth") - p) ** 2)
        means = out.groupBy(SITE).agg(F.avg("before").alias("mean"))
        better = out.join(means, SITE).agg((error(F.col("TAIR")) < 0.5 * error(F.col("mean"))).alias("beats_mean"))
        counts = out.groupBy(SITE).agg(
            F.count(F.when(F.col("before") == F.col("TAIR"), 1)).alias("unchanged"),
            F.count(F.when(F.col("before").isNull() & F.col("TAIR").isNotNull(), 1)).alias("filled"),
            F.count(F.when(F.col("TAIR").isNull(), 1)).alias("still_missing"),
        )
        return counts.withColumn("beats_mean", F.lit(better.first()[0]))

    return run


def _fill_sql(usable: str) -> str:
    """Every usable row of a site that has one to learn from is filled."""
    return with_station(
        f", t AS (SELECT {SITE}, CASE WHEN event_id % 7 <> 0 THEN TAIR END AS v, row_number() OVER (PARTITION BY {SITE} ORDER BY {TIME}, event_id) AS k FROM st), "
        f"s AS (SELECT *, {usable} AND count(CASE WHEN {usable} THEN v END) OVER (PARTITION BY {SITE}) > 0 AS known FROM t) "
        f"SELECT {SITE}, count(v) AS unchanged, count(*) FILTER (v IS NULL AND known) AS filled, count(*) FILTER (v IS NULL AND NOT known) AS still_missing, true AS beats_mean FROM s GROUP BY {SITE}"
    )


def _importance(spark, folder):
    """In every group the sensor that the target depends on ranks above a column of hashes."""
    st = station(spark, folder, ["DWPT", "WSPD", "PRES"]).withColumn("noise", _noise("event_id"))
    spec = SPEC.but(site=("event_type",))
    ranks, scored = site_models.importance_all_sites(st, spec, "DWPT", ["WSPD", "PRES", "noise"], trees=4, growth=Growth(depth=5, least=2.0, l2=0.0))
    place = lambda f: F.max(F.when(F.col("feature") == f, F.col("rank")))
    by = ranks.groupBy("site").agg(place("WSPD").alias("signal_rank"), (place("noise") > place("WSPD")).alias("above_noise"), F.round(F.sum("importance"), 6).alias("total"))
    return by.join(scored.select("site", (F.col("r2") > 0.5).alias("predicts")), "site")


# -- exact Shapley values -----------------------------------------------------------------------------
SHAPLEY_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def _tree_shapley(spark, folder):
    """Exact values of every row under two trees of two levels."""
    rows = lines(spark, folder).select(*LINE_KEYS, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    learned = rows.select("l_returnflag", *SHAPLEY_FEATURES, "l_extendedprice")
    # without draws no key is read
    model, _ = grouped_trees.fit_boosted(learned, ["l_returnflag"], SHAPLEY_FEATURES, "l_extendedprice", [], growth=Growth(rounds=1, depth=2, rate=1.0, l2=0.0, bins=256, bits=52))
    found = tree_shapley.tree_shapley(model, rows, LINE_KEYS)
    return rounded(found.select(*LINE_KEYS, "feature", "phi", "expected"), 3)


def _shapley_sql() -> str:
    """Two levels grown in SQL, then all subsets of four features for every row."""
    names, numbers = list(SHAPLEY_FEATURES), list(range(4))
    values = ", ".join(f"cast({f} AS double)" for f in names)
    ctes = [
        f"r AS (SELECT row_number() OVER () AS id, {', '.join(LINE_KEYS)}, [{values}] AS x, l_extendedprice AS y FROM lineitem)",
        "b AS (SELECT l_returnflag, avg(y) AS base FROM r GROUP BY l_returnflag)",
        "t0 AS (SELECT r.l_returnflag AS g, 1 AS node, id, x, base - y AS d FROM r JOIN b USING (l_returnflag))",
    ]
    for k in range(2):
        ctes += [
            f"u{k} AS (SELECT g, node, f, v, sum(d) AS s, count(*) AS n FROM (SELECT g, node, d, unnest({numbers}) AS f, unnest(x) AS v FROM t{k}) GROUP BY ALL)",
            f"w{k} AS (SELECT *, sum(s) OVER a AS gl, sum(n) OVER a AS hl, sum(s) OVER w AS ga, sum(n) OVER w AS ha FROM u{k} WINDOW a AS (PARTITION BY g, node, f ORDER BY v), w AS (PARTITION BY g, node, f))",
            f"c{k} AS (SELECT g, node, arg_max(struct_pack(f := f, v := v, n := hl), (cast(gain AS float), -f, -v)) AS b FROM "
            f"(SELECT *, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha AS gain FROM w{k} WHERE ha > hl) WHERE gain > 0 GROUP BY g, node)",
            f"t{k + 1} AS (SELECT t.g, node * 2 + CASE WHEN x[b.f + 1] > b.v THEN 1 ELSE 0 END AS node, id, x, d FROM t{k} t JOIN c{k} c USING (g, node))",
        ]
    ctes += [
        "leaf AS (SELECT g, node, -avg(d) AS value, count(*) AS n FROM t2 GROUP BY g, node)",
        "halves AS (SELECT g, node // 2 AS up, count(*) AS n FROM t2 GROUP BY ALL)",
        "total AS (SELECT g, count(*) AS n FROM t2 GROUP BY g)",
        # a leaf's two conditions, with the share of rows that take each branch
        "path AS (SELECT leaf.g, leaf.node, value, c0.b.f AS f1, c0.b.v AS v1, (leaf.node // 2) % 2 AS s1, halves.n / total.n AS z1, c1.b.f AS f2, c1.b.v AS v2, leaf.node % 2 AS s2, leaf.n / halves.n AS z2 "
        "FROM leaf JOIN halves ON halves.g = leaf.g AND up = leaf.node // 2 JOIN total ON total.g = leaf.g JOIN c0 ON c0.g = leaf.g JOIN c1 ON c1.g = leaf.g AND c1.node = leaf.node // 2)",
        # a row meets at most a few combinations of which conditions hold
        "held AS (SELECT r.id, r.l_returnflag AS g, list(CASE WHEN (x[f1 + 1] > v1) = (s1 = 1) THEN 1 ELSE 0 END ORDER BY node) AS o1, list(CASE WHEN (x[f2 + 1] > v2) = (s2 = 1) THEN 1 ELSE 0 END ORDER BY node) AS o2 "
        "FROM r JOIN path ON path.g = r.l_returnflag GROUP BY r.id, r.l_returnflag)",
        "kind AS (SELECT DISTINCT g, o1, o2 FROM held)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY node) AS place FROM path)",
        "game AS (SELECT kind.g, o1, o2, known, sum(value * CASE WHEN (known >> f1) & 1 = 1 THEN o1[place] ELSE z1 END * CASE WHEN (known >> f2) & 1 = 1 THEN o2[place] ELSE z2 END) AS v "
        "FROM kind JOIN placed USING (g), (SELECT unnest(range(16)) AS known) GROUP BY kind.g, o1, o2, known)",
        "phi AS (SELECT a.g, a.o1, a.o2, f, sum((w.v - a.v) * CASE bit_count(a.known) WHEN 0 THEN 0.25e0 WHEN 1 THEN 1 / 12e0 WHEN 2 THEN 1 / 12e0 ELSE 0.25e0 END) AS phi "
        "FROM game a, (SELECT unnest(range(4)) AS f) JOIN game w ON w.g = a.g AND w.o1 = a.o1 AND w.o2 = a.o2 AND w.known = a.known + (1 << f) WHERE (a.known >> f) & 1 = 0 GROUP BY a.g, a.o1, a.o2, f)",
        "mean AS (SELECT b.l_returnflag AS g, base + sum(value * z1 * z2) AS expected FROM b JOIN path ON path.g = b.l_returnflag GROUP BY b.l_returnflag, base)",
    ]
    return (
        f"WITH {', '.join(ctes)} SELECT {', '.join('r.' + k for k in LINE_KEYS)}, {names}[f + 1] AS feature, {r('phi', 'phi', 3)}, {r('expected', 'expected', 3)} "
        "FROM r JOIN held USING (id) JOIN phi ON phi.g = held.g AND phi.o1 = held.o1 AND phi.o2 = held.o2 JOIN mean ON mean.g = held.g"
    )


QUERIES: dict[str, Query] = {
    "newton_boosting": Query(_newton, NEWTON_SQL),
    "newton_boosting_held_out": Query(_learning, LEARNING_SQL),
    "forecast_all_sites": Query(_all_sites, ALL_SITES_SQL),
    # the first row of a site has no lags, so under 70 % of its features are known
    "fill_all_sites": Query(_fill(site_models.FILL_BOOSTED, Growth(rounds=3, depth=3, rate=0.7, least=2.0)), _fill_sql("k > 1")),
    "forest_fill_all_sites": Query(_fill(site_models.FILL_FOREST, Growth(depth=4, least=2.0, l2=0.0), trees=4), _fill_sql("true")),
    "forest_importance_all_groups": Query(
        _importance, "SELECT DISTINCT event_type AS site, 1 AS signal_rank, true AS above_noise, 1.0e0 AS total, true AS predicts FROM events"
    ),
    "tree_shapley": Query(_tree_shapley, _shapley_sql()),
}
