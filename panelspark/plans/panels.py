"""From raw tables to the eight panels.

Raw inputs, as DataFrames (read them with ``sources.readers``):

* animal case reports, any number of layouts, conformed to REPORT_COLUMNS
* monthly human counts: periodname, organisation unit, one column per diagnosis
* population projections, a human census, a livestock census
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import columns as C
from panelspark.functions import vocab as V
from panelspark.operators import joins, reshape, rollup, rows
from panelspark.sources import sinks

# FIXED VALUES: column names of the input files and of the published panels
REPORT_COLUMNS = ["county", "month", "year", "disease_condition", "diagnosis", "species", "no_sick"]
PANEL_KEYS = ["region", "year", "month", "diagnosis"]
ANIMAL_POPS = ["catt_pop", "goat_pop", "sheep_pop", "cam_pop"]
FIRST_YEAR, LAST_YEAR, CENSUS_YEAR = 2014, 2022, 2019


# ---------------------------------------------------------------- denominators


def projection_long(sheet: DataFrame, years: Sequence[int], region: str = "County") -> DataFrame:
    """(region, year, pop) from a sheet with a text column of thousands per year; incomplete rows drop."""
    parsed = sheet.select(
        F.col(region).alias("region"), *[C.parse_number(F.col(f"`{y}`"), 1000).alias(str(y)) for y in years]
    )
    long = rows.complete_cases(parsed).unpivot(["region"], [str(y) for y in years], "year", "pop")
    return long.withColumn("year", F.col("year").cast("int"))


def early_projection(sheet: DataFrame, years: Sequence[int] = (2014, 2015), region: str = "County") -> DataFrame:
    """The older sheet's rows for single regions, duplicates dropped."""
    kept = rows.filter_in(sheet, region, V.PROJECTION_AGGREGATES, keep=False)
    return kept.distinct().select(F.col(region).alias("region"), *[F.col(f"`{y}`") for y in years])


def growth_rates(projection: DataFrame, country: str = "Kenya") -> DataFrame:
    """Mean yearly growth per region, in per cent, two decimals."""
    return rollup.mean_growth(projection.where(F.col("region") != country), "region", "year", "pop")


def human_denominators(
    census: DataFrame,
    projection: DataFrame,
    country: str = "Kenya",
    region: str = "County",
    total: str = "Total",
    first: int = FIRST_YEAR,
    last: int | None = None,
) -> DataFrame:
    """(region, year, pop): census year carried back to ``first`` by growth, later years as far as the projection goes."""
    base = rows.filter_in(census, region, ["Total"], keep=False).select(
        C.recode(F.col(region), V.CENSUS_REGION_MAP).alias("region"), F.col(total).alias("base")
    )
    grown = joins.join_inner(base, growth_rates(projection, country), ["region"])
    past = rows.backcast(grown, "base", "growth_rate", CENSUS_YEAR, CENSUS_YEAR - first)
    later = projection.where((F.col("region") != country) & (F.col("year") > CENSUS_YEAR)).select("region", "year", "pop")
    if last is not None:
        later = later.where(F.col("year") <= last)
    return joins.union_all(past, later)


def livestock_denominators(census: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """(region, year, animal populations): subcounty rows summed by region and repeated for each year."""
    cattle = [F.col(c).cast("long") for c in rows.cols_like(census, "Cattle")]
    subcounties = census.where((F.col("AdminArea") != "County") & (F.col("County") != "xxx")).select(
        C.recode(C.norm_text(F.col("County"), "title"), V.CENSUS_REGION_MAP).alias("region"),
        C.row_sum(cattle, skip_nulls=True).alias("catt_pop"),
        F.col("Goats").alias("goat_pop"),
        F.col("Sheep").alias("sheep_pop"),
        F.col("Camels").alias("cam_pop"),
    )
    return reshape.year_spine(rollup.sum_by(subcounties, ["region"], ANIMAL_POPS), first, last)


# ---------------------------------------------------------------- case reports


def stack_reports(*layouts: tuple[DataFrame, dict[str, str | Column]]) -> DataFrame:
    """Layouts with their column mappings, conformed and stacked."""
    return joins.union_all(*[rows.conform(df, mapping).select(*REPORT_COLUMNS) for df, mapping in layouts])


def clean_reports(reports: DataFrame) -> DataFrame:
    """Canonical region, month, disease, diagnosis and series of each report, in one projection."""
    present = rows.filter_present(reports, "month", "county")
    titled = present.select(
        C.norm_text(F.col("county"), "title").alias("county"),
        C.month_from_parts(F.col("month"), F.col("year")).alias("month"),
        F.col("year").cast("int").alias("year"),
        C.regex_class(F.col("disease_condition"), V.DISEASE_PATTERN, V.DISEASE).alias("disease"),
        C.norm_text(F.col("diagnosis"), "title").alias("diagnosis"),
        C.norm_text(F.col("species"), "title").alias("species"),
        F.col("no_sick").cast("long").alias("no_sick"),
    )
    return titled.select(
        C.recode(F.col("county"), V.REGION_MAP).alias("region"),
        "year",
        "month",
        "disease",
        C.recode(F.col("diagnosis"), V.DIAGNOSIS_MAP, V.CLINICAL).alias("diagnosis"),
        C.recode(F.col("species"), V.SPECIES_MAP).alias("species"),
        "no_sick",
    )


def animal_panel(cleaned: DataFrame, livestock: DataFrame) -> DataFrame:
    """(region, year, month, diagnosis) with a count per animal series and the animal denominators.

    The filter comes before the aggregate, and each series is named by its label,
    not by its place.
    """
    kept = cleaned.where((F.col("disease") == V.DISEASE) & F.col("species").isin(list(V.SPECIES_TO_SERIES)))
    names = {label: f"{series}_cases" for label, series in V.SPECIES_TO_SERIES.items()}
    counted = rollup.sum_by(kept, [*PANEL_KEYS, "species"], ["no_sick"])
    wide = reshape.pivot(counted, PANEL_KEYS, "species", names, "no_sick")
    return joins.join_inner(wide, livestock, ["region", "year"])


def human_panel(
    monthly: DataFrame,
    populations: DataFrame,
    columns: dict[str, str],
    region: str = "county",
    period: str = "periodname",
    suffix: str = " County",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """(region, year, month, diagnosis, hum_cases, pop); ``columns`` maps a diagnosis to its count column."""
    label = C.squish(C.remove_first(F.col(region), suffix))
    month = C.to_month(F.col(period))
    wide = monthly.select(
        C.recode(label, names or {"Muranga": "Murang'a"}).alias("region"),
        F.year(month).alias("year"),
        month.alias("month"),
        *[F.col(source).cast("double").alias(diagnosis) for diagnosis, source in columns.items()],
    )
    long = reshape.unpivot(wide, ["region", "year", "month"], list(columns), "diagnosis", "hum_cases")
    return joins.join_inner(long, populations.select("region", "year", "pop"), ["region", "year"])


# ---------------------------------------------------------------- panels


def key_audit(human: DataFrame, animal: DataFrame) -> dict[str, DataFrame]:
    """Labels of one side that the other lacks, to look at before the outer join."""
    return {
        "regions_without_reports": joins.setdiff(human, animal, "region"),
        "diagnoses_without_counts": joins.setdiff(animal, human, "diagnosis"),
    }


def base_panel(human: DataFrame, animal: DataFrame) -> DataFrame:
    """Both sides on one key, outliers replaced, rates added."""
    joined = joins.join_full(human, animal, PANEL_KEYS)
    fixed = rows.replace_outliers(joined, V.OUTLIER_LIMITS)
    return rows.rate_columns(fixed, rollup.RATE_PAIRS)


def all_denominators(livestock: DataFrame, humans: DataFrame) -> DataFrame:
    return joins.join_inner(livestock, humans, ["region", "year"])


def build_panels(panel: DataFrame, livestock: DataFrame, humans: DataFrame) -> dict[str, DataFrame]:
    """The eight tables: the base panel and its seven roll-ups.

    Pass a base panel that has been written out (``session.materialise``) when all
    eight are to be stored, so that the reports are read once.
    """
    rolled = rollup.panel_rollup(panel, all_denominators(livestock, humans))
    return {"ah": panel, **{name: rollup.grain(rolled, name) for name in rollup.GRAINS}}


def later_year(
    human: DataFrame, animal: DataFrame, livestock: DataFrame, humans: DataFrame, limit: float = 900_000
) -> DataFrame:
    """A later year prepared like the national monthly panel; a month beyond ``limit`` gets the mean of the others."""
    joined = joins.join_full(human, animal, PANEL_KEYS)
    monthly = rollup.sum_by(joined, ["month", "year"], rollup.CASES)
    den = all_denominators(livestock, humans)
    counts = joins.join_rolled_denominator(monthly, den, ["year"], rollup.POPS)
    fixed = rows.replace_outliers(counts, [("hum_cases", limit, ">")], mean_of="below")
    return rows.rate_columns(fixed, rollup.RATE_PAIRS)


SERIES_COLUMNS = ["year", "month", *rollup.CASES, *rollup.POPS, *rollup.RATE_PAIRS]


def extend_series(history: DataFrame, *later: DataFrame) -> DataFrame:
    """The national monthly panel with later years stacked below."""
    cols = SERIES_COLUMNS
    typed = [df.select("year", "month", *[F.col(c).cast("double").alias(c) for c in cols[2:]]) for df in (history, *later)]
    return joins.union_all(*typed)


def publish_years(panel: DataFrame, path: str) -> None:
    """Write the years that ``panel`` has to the published panel; a year that is there already is replaced, others aren't touched.

    Delivering a year twice equals delivering it once. Years of ``panel`` must be whole.
    """
    sinks.replace_partitions(panel, path, ["year"])


def read_years(spark: SparkSession, path: str) -> DataFrame:
    """The published panel, in the columns of ``extend_series``."""
    kinds = {"year": "INT", "month": "DATE"}
    schema = ", ".join(f"{c} {kinds.get(c, 'DOUBLE')}" for c in SERIES_COLUMNS)
    return spark.read.schema(schema).parquet(path).select(*SERIES_COLUMNS)


def static_livestock(livestock: DataFrame, year: int) -> DataFrame:
    """The static animal populations set down for another year."""
    one = rollup.first_by(livestock, ["region"], ANIMAL_POPS, "year")
    return one.withColumn("year", F.lit(year))
