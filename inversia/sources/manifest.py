"""File names, time spines, missing-file manifests and data maturity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: <product>_<variable>_<region>_<resolution>_<yyyymmdd>, then a suffix.
NAME_PATTERN = r"^(\w+)_(\w+)_(\w+)_(\w+)_(\d{8})"
STABLE_AFTER_MONTHS = 6


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_parts(name: Column, suffix: str = r"\.bil$") -> dict[str, Column]:
    """Metadata of a grid file name; all null where the name does not match."""
    pattern = NAME_PATTERN + suffix
    fits = name.rlike(pattern)
    part = lambda i: F.when(fits, F.regexp_extract(name, pattern, i))
    return {
        "product": part(1),
        "variable": part(2),
        "region": part(3),
        "resolution": part(4),
        "date": F.try_to_date(part(5), "yyyyMMdd"),
    }


def parse_names(df: DataFrame, name: str, suffix: str = r"\.bil$") -> DataFrame:
    """Add the name's metadata and drop files that do not match."""
    return df.withColumns(name_parts(F.col(name), suffix)).where(F.col("date").isNotNull())


def name_report(df: DataFrame, name: str, suffix: str = r"\.bil$") -> DataFrame:
    """How many names match and how many do not."""
    parsed = name_parts(F.col(name), suffix)["date"].isNotNull()
    return df.agg(F.count(F.when(parsed, 1)).alias("matched"), F.count(F.when(~parsed, 1)).alias("skipped"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes below a folder. Contents are not read: the column is pruned."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", file_name(F.col("path")).alias("name"))
    )


def years_of(files: DataFrame, path: str = "path", pattern: str = r"/(\d{4})/") -> DataFrame:
    """Years for which files exist, from the year folder in their path."""
    year = F.regexp_extract(path, pattern, 1)
    return files.where(year != "").select(year.cast("int").alias("year")).distinct().orderBy("year")


def choose(files: DataFrame, years: Sequence[int] | None = None, pattern: str | None = None) -> DataFrame:
    """Files of the given years whose name contains the pattern."""
    out = files
    if years is not None:
        out = out.where(F.col("year").isin(*years))
    if pattern is not None:
        out = out.where(F.col("name").contains(pattern))
    return out


def time_spine(spark: SparkSession, start, end, step_seconds: int, name: str = "timestamp") -> DataFrame:
    """All steps in [start, end), spread over the cluster."""
    steps = max(0, -(-int((end - start).total_seconds() * 1_000_000) // (step_seconds * 1_000_000)))
    first = F.lit(start).cast("timestamp_ntz")
    return spark.range(steps).select(
        (first + F.make_dt_interval(secs=F.col("id") * F.lit(step_seconds))).alias(name)
    )


def expected_files(spine: DataFrame, variables: Sequence[str], name: str = "variable") -> DataFrame:
    """Every step of a spine for every variable."""
    return spine.withColumn(name, F.explode(F.array(*[F.lit(v) for v in variables])))


def missing_from(expected: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is expected but not there; with a size among the keys, also what has the wrong size."""
    return expected.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def months_between(earlier: Column, later: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def maturity(date: Column, as_of: Column) -> Column:
    """early, provisional or stable by whole months since the data date."""
    age = months_between(date, as_of)
    return F.when(age < 1, "early").when(age < STABLE_AFTER_MONTHS, "provisional").otherwise("stable")


def maturity_of_year(year: Column, as_of: Column) -> Column:
    """stable or provisional for a whole year, counted from its December."""
    age = (F.year(as_of) - year) * 12 + F.month(as_of) - 12
    return F.when(age >= STABLE_AFTER_MONTHS, "stable").otherwise("provisional")


def kelvin_to_celsius(variable: Column, value: Column) -> Column:
    """Temperatures of a decoded analysis grid in degrees Celsius; other variables unchanged."""
    return F.when(F.lower(variable).isin("t2m", "tmp"), value - 273.15).otherwise(value)


def convert_grid(grid: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Decoded long grid (variable, value, ...): the wanted variables, temperatures converted.
    A variable the grid lacks is simply absent."""
    wanted = grid.where(F.col("variable").isin(*variables))
    return wanted.withColumn("value", kelvin_to_celsius(F.col("variable"), F.col("value")))
