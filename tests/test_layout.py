"""Cut series give the same results as uncut ones, at any number of partitions."""

import pytest
from pyspark.sql import functions as F

from inversia.operators import filters, impute, modeling, quality, windows
from inversia.operators.quantiles import exact_quantiles
from inversia.plans.layout import plan_layout, settled
from tests.helpers import SPEC, hot_table, same

CUT = SPEC.but(rows_per_chunk=50)
JOBS = {
    "lags": lambda df, s: windows.add_lags(df, s, ["v"], [1, 12]),
    "targets": lambda df, s: windows.add_targets(df, s, ["v"], [1, 12]),
    "rolling": lambda df, s: windows.add_rolling(df, s, ["v"], [3, 12]),
    "events": lambda df, s: windows.inversion_events(df, s, F.col("v")),
    "event_summary": lambda df, s: windows.event_summary(df, s, F.col("v")),
    "missing_runs": lambda df, s: quality.missing_runs(df, s, ["v", "u"]),
    "gap_analysis": lambda df, s: quality.gap_analysis(df, s, ["v", "u"]),
    "time_gaps": lambda df, s: quality.time_gaps(df, s),
    "periods": lambda df, s: quality.continuous_periods(df, s),
    "completeness": lambda df, s: quality.completeness(df, s),
    "chunks": lambda df, s: quality.complete_chunks(df, s, ["v", "u"]),
    "chunk_gaps": lambda df, s: quality.chunk_gaps(df, s, ["v", "u"]),
    "chunk_summary": lambda df, s: quality.chunk_summary(df, s, ["v", "u"]),
    "missing_log": lambda df, s: quality.missing_log(
        df.withColumns({"v": F.col("v").cast("string"), "u": F.col("u").cast("string")}), s, ["v", "u"]
    ),
    "linear": lambda df, s: impute.linear_fill(df, s, ["v", "u"], 4, directions=["u"]),
    "both_ways": lambda df, s: impute.forward_backward_fill(df, s, ["v", "u"], 5),
    "fill_all": lambda df, s: impute.fill_all(df, s, ["v", "u"]),
    "differences": lambda df, s: windows.add_differences(df.withColumnsRenamed({"v": "VT20", "u": "WDIR"}), s),
    "split": lambda df, s: modeling.chronological_split(df, s),
    "folds": lambda df, s: modeling.contiguous_folds(df, s),
    "thin": lambda df, s: modeling.thin(df, s, 37),
}


@pytest.fixture(scope="module")
def table(spark):
    return hot_table(spark).repartition(5).cache()


def test_the_hot_site_is_cut(table):
    layout = plan_layout(table, CUT)
    assert layout.cut and ("hot",) in layout.cells
    sizes = layout.spread(table).where("_own").groupBy("site", "_chunk").count().toPandas()
    hot = sizes[sizes.site == "hot"]
    assert len(hot) >= 4 and hot["count"].max() <= 2 * layout.rows
    assert not plan_layout(table, SPEC).cut


@pytest.mark.parametrize("name", JOBS)
def test_cut_equals_whole(table, name):
    assert same(JOBS[name](table, SPEC), JOBS[name](table, CUT))


@pytest.fixture(scope="module")
def troubled(spark):
    """Null times, repeated times, and a text tie-break that alone tells many rows apart."""
    df = hot_table(spark)
    early = F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 4 == 0, F.lit("2024-01-02").cast("timestamp_ntz"))
    named = df.withColumn("ts", F.coalesce(early, F.when(F.col("id") % 9 != 0, F.col("ts"))))
    return named.withColumn("name", F.concat(F.lit("a long common beginning "[:9]), F.format_string("%06d", F.pmod(F.col("id") * 7919, F.lit(100_003)))))


# times are compared and subtracted in these, so a null time has no place in them
TIMED = {"time_gaps", "periods", "completeness", "events", "event_summary"}


@pytest.mark.parametrize("name", [n for n in JOBS if n not in TIMED])
def test_null_and_repeated_times(troubled, name):
    whole = SPEC.but(tiebreak=("name",))
    cut = whole.but(rows_per_chunk=40)
    layout = plan_layout(troubled, cut)
    sizes = layout.spread(troubled).where("_own").groupBy("site", "_chunk").count().toPandas()
    assert sizes["count"].max() <= 2 * layout.rows
    assert same(JOBS[name](troubled, whole), JOBS[name](troubled, cut))


def test_series_without_any_time(spark):
    df = hot_table(spark).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    for name in ("split", "rolling", "fill_all"):
        assert same(JOBS[name](df, SPEC), JOBS[name](df, CUT))


def test_cells_are_split_until_they_fit(spark):
    """Gaps of ever larger scale: many levels of cells."""
    df = spark.createDataFrame([("hot", 2**40 * (i % 2) + 4 ** (i % 20), i, float(i)) for i in range(800)], "site string, n bigint, id bigint, v double")
    spec = SPEC.but(ts="n", tiebreak=("id",))
    cut = spec.but(rows_per_chunk=8)
    layout = plan_layout(df, cut)
    assert len(layout.levels) > 4
    sizes = layout.spread(df).where("_own").groupBy("_chunk").count().toPandas()
    assert sizes["count"].max() <= 2 * layout.rows
    for name in ("split", "rolling"):
        assert same(JOBS[name](df, spec), JOBS[name](df, cut))


def test_numbers_beyond_doubles_go_by_the_tie_break(spark):
    df = spark.createDataFrame([("hot", 2**60 + i % 3, i, 1.0) for i in range(300)], "site string, n bigint, id bigint, v double")
    spec = SPEC.but(ts="n", tiebreak=("id",))
    assert same(JOBS["split"](df, spec), JOBS["split"](df, spec.but(rows_per_chunk=20)))


@pytest.mark.parametrize("name", ["events", "linear", "rolling"])
def test_one_series_without_site(table, name):
    one = SPEC.but(site=())
    assert same(JOBS[name](table, one), JOBS[name](table, one.but(rows_per_chunk=64)))


def test_position_and_length(table):
    out = {}
    for spec in (SPEC, CUT):
        layout = plan_layout(table, spec)
        rows = layout.spread(table)
        rows = layout.own(rows.withColumns({"at": layout.position(), "n": layout.length()}))
        out[spec] = rows
    assert same(out[SPEC], out[CUT])
    ends = out[CUT].groupBy("site").agg(F.max("at") + 1 - F.max("n"), F.count("*") - F.max("n"))
    assert all(r[1] == 0 and r[2] == 0 for r in ends.collect())


def test_quantiles_cut_equals_pandas(table):
    for limit in (10, 10**6):
        got = exact_quantiles(table, ["v", "u"], {"a": 0.001, "m": 0.5, "z": 0.999}, ["site"], rows_per_chunk=limit)
        pdf = table.toPandas()
        for r in got.collect():
            want = pdf[pdf.site == r["site"]][r["variable"]].quantile([0.001, 0.5, 0.999]).tolist()
            assert [round(r[k], 9) for k in "amz"] == [round(x, 9) for x in want]


def test_partition_count_does_not_matter(spark, table):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = JOBS["events"](table, SPEC).toPandas().sort_values(["site", "start_time"]).values.tolist()
    try:
        for n in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for spec in (SPEC, CUT):
                got = JOBS["events"](table.repartition(n), spec).toPandas()
                assert got.sort_values(["site", "start_time"]).values.tolist() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_times_are_cut_by_the_tie_break(spark):
    """Half of the hot site's rows share one time; they are cut along the tie-break."""
    table = hot_table(spark).withColumn(
        "ts", F.when((F.col("site") == "hot") & (F.col("id") % 2 == 0), F.lit("2024-02-01").cast("timestamp_ntz")).otherwise(F.col("ts"))
    )
    layout = plan_layout(table, CUT)
    sizes = layout.spread(table).where("_own").groupBy("site", "_chunk").count().toPandas()
    assert sizes["count"].max() <= 2 * layout.rows
    for name in ("events", "linear", "rolling", "time_gaps"):
        assert same(JOBS[name](table, SPEC), JOBS[name](table, CUT))


def count_scans(spark, work):
    """Rows read from the counted table while ``work`` plans, in units of the table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    work(counted)
    return seen.value


def test_planning_reads_the_table_once(spark):
    df = hot_table(spark).cache()
    rows = df.count()
    assert count_scans(spark, lambda counted: plan_layout(counted(df), SPEC)) == rows
    # a cut table: once for the lengths, once for each level of cells
    levels = len(plan_layout(df, CUT).levels)
    assert count_scans(spark, lambda counted: plan_layout(counted(df), CUT)) == rows * (1 + levels)


def test_a_median_reads_the_table_once(spark):
    df = hot_table(spark).cache()
    rows = df.count()

    def median(counted):
        exact_quantiles(counted(df), ["v", "u"], {"m": 0.5}).collect()

    assert count_scans(spark, median) == rows


def test_settled_layout_is_reused(table):
    spec = settled(table, CUT)
    assert plan_layout(table, spec) is spec.layout and spec == CUT
    assert same(JOBS["rolling"](table, SPEC), JOBS["rolling"](table, spec))
