"""The path from raw tables to panels and result tables, on a few hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import rollup
from panelspark.plans import analyses, panels

D = dt.date


@pytest.fixture(scope="module")
def livestock(spark):
    cols = "County STRING, SubCounty STRING, AdminArea STRING, ExoticCattle_Dairy INT, ExoticCattle_Beef INT, IndigenousCattle INT, Goats INT, Sheep INT, Camels INT"
    data = [
        ("KITUI", "all", "County", 9, 9, 9, 9, 9, 9),
        ("xxx", "x", "SubCounty", 9, 9, 9, 9, 9, 9),
        ("KITUI", "one", "SubCounty", 100, None, 200, 50, 10, 0),
        ("KITUI", "two", "SubCounty", 100, 100, 500, 150, 30, 0),
        ("THARAKA-NITHI", "one", "SubCounty", 1, 2, 997, 1000, 400, 80),
    ]
    return panels.livestock_denominators(spark.createDataFrame(data, cols))


@pytest.fixture(scope="module")
def humans(spark):
    years = [2020, 2021, 2022, 2023, 2024, 2025]
    sheet = spark.createDataFrame(
        [
            ("Kenya", "9", "9", "9", "9", "9", "9"),
            ("Kitui", "1,000", "1,010", "1,020", "1,030", "1,040", "1,050"),
            ("Tharaka Nithi", "400", "404", "408", "412", "416", "420"),
            (None, None, None, None, None, None, None),
        ],
        "County STRING, " + ", ".join(f"`{y}` STRING" for y in years),
    )
    census = spark.createDataFrame([("Kitui", 990000), ("Tharaka-Nithi", 396000), ("Total", 5)], "County STRING, Total INT")
    return panels.human_denominators(census, panels.projection_long(sheet, years))


@pytest.fixture(scope="module")
def animal(spark, livestock):
    first = spark.createDataFrame(
        [
            ("mwingi", "March", 2020, "Bovine brucellosis", "clinical", "cattle ", 3),
            ("Kitui", "mar", 2020, "BRUCELLA abortus", None, "Bovine", 2),
            ("KITUI", "March", 2020, "Anthrax", "Lab", "Bovine", 50),
            ("Kitui", None, 2020, "Brucellosis", "Lab", "Bovine", 50),
            ("", "March", 2020, "Brucellosis", "Lab", "Bovine", 50),
        ],
        "County STRING, Month STRING, year INT, Disease STRING, Diag STRING, Species STRING, Sick INT",
    )
    second = spark.createDataFrame(
        [
            ("Tharaka-Nithi", "April", 2020, "Brucellosis", "pm &lb", "Caprine+Donkey", 7),
            ("Tharaka-nithi", "April", 2020, "Brucellosis", "Laboratory", "sheep", 1),
            ("Tharaka-nithi", "April", 2020, "Brucellosis", "Laboratory", "Dogs/Donkey", 1),
        ],
        "`Sub-County` STRING, M STRING, Y INT, D STRING, N STRING, S STRING, K INT",
    )
    reports = panels.stack_reports(
        (first, {"county": "County", "month": "Month", "year": "year", "disease_condition": "Disease", "diagnosis": "Diag", "species": "Species", "no_sick": "Sick"}),
        (second, {"county": "Sub-County", "month": "M", "year": "Y", "disease_condition": "D", "diagnosis": "N", "species": "S", "no_sick": "K"}),
    )
    return panels.animal_panel(panels.clean_reports(reports), livestock)


@pytest.fixture(scope="module")
def human(spark, humans):
    monthly = spark.createDataFrame(
        [("March 2020", "Kitui County", 100, 40), ("April 2020", "Kitui County", 200, None), ("April 2020", " Tharaka  Nithi County", 50, 5)],
        "periodname STRING, county STRING, a INT, b INT",
    )
    return panels.human_panel(monthly, humans, {"Clinically confirmed": "a", "Lab confirmed": "b"})


def test_livestock(livestock):
    got = {(r.region, r.year): r for r in livestock.collect()}
    assert len(got) == 18
    assert got[("Kitui", 2014)].catt_pop == 1000 and got[("Tharaka Nithi", 2022)].goat_pop == 1000


def test_humans(humans):
    got = {(r.region, r.year): r.pop for r in humans.collect()}
    assert sorted({y for _, y in got}) == list(range(2014, 2026))
    assert got[("Kitui", 2021)] == 1010000 and got[("Kitui", 2019)] == 990000
    growth = round(sum(10 / (1000 + 10 * i) for i in range(5)) / 5 * 100, 2)
    assert got[("Kitui", 2018)] == round(990000 * (1 - growth / 100))


def test_animal_panel(animal):
    got = {(r.region, r.month, r.diagnosis): r for r in animal.collect()}
    assert set(got) == {("Kitui", D(2020, 3, 1), "Clinically confirmed"), ("Tharaka Nithi", D(2020, 4, 1), "Lab confirmed")}
    first = got[("Kitui", D(2020, 3, 1), "Clinically confirmed")]
    assert (first.catt_cases, first.cam_cases, first.cam_pop) == (5, None, 0)
    second = got[("Tharaka Nithi", D(2020, 4, 1), "Lab confirmed")]
    assert (second.goat_cases, second.shp_cases, second.catt_cases) == (7, 1, None)


def test_panels(human, animal, livestock, humans):
    base = panels.base_panel(human, animal)
    audit = panels.key_audit(human, animal)
    assert audit["regions_without_reports"].count() == 0 and audit["diagnoses_without_counts"].count() == 0
    assert base.count() == 6
    eight = panels.build_panels(base, livestock, humans)
    assert set(eight) == {"ah", *rollup.GRAINS}
    year = eight["kenya_yah2"].first()
    assert (year.hum_cases, year.catt_cases, year.goat_cases, year.pop) == (395.0, 5.0, 7.0, 1400000)
    assert year.cam_incidence == 0.0 and abs(year.catt_incidence - 5 / 2000 * 1e6) < 1e-9
    monthly = {r.month: r for r in eight["kenya_ah2"].collect()}
    assert monthly[D(2020, 4, 1)].hum_cases == 255.0
    regional = {r.region: r for r in eight["yah2"].collect()}
    assert regional["Kitui"].cam_incidence is None
    later = panels.later_year(human, animal, livestock, humans, limit=200)
    assert {r.month: r.hum_cases for r in later.collect()} == {D(2020, 3, 1): 140.0, D(2020, 4, 1): 140.0}
    assert panels.extend_series(eight["kenya_ah2"], later).count() == 4
    static = panels.static_livestock(livestock, 2023).collect()
    assert {(r.region, r.year, r.catt_pop) for r in static} == {("Kitui", 2023, 1000), ("Tharaka Nithi", 2023, 1000)}


def test_descriptions_and_pictures(spark, human, animal, livestock, humans):
    eight = panels.build_panels(panels.base_panel(human, animal), livestock, humans)
    tables = analyses.descriptives(eight)
    shown = {r["Species"]: r for r in tables["national_display"].collect()}
    assert shown["Human"]["Total cases"] == "395" and shown["Human"]["Lab confirmed"] == "45 (11.39%)"
    assert shown["Camel"]["Clinically confirmed"] == "0 (0.00%)"
    assert tables["regional"].count() == 10 and "region" in tables["regional_display"].columns
    names = spark.createDataFrame([("Kitui",), ("Tharaka-Nithi",)], "region STRING")
    maps = {r.region: r for r in analyses.pictures(eight, names)["maps"].collect()}
    assert set(maps) == {"Kitui", "Tharaka-Nithi"} and maps["Kitui"].cat_label_cam_incidence == "0"


def test_analyses_on_a_long_panel(spark):
    n = 60
    months = [D(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]
    data = [
        (m, m.year, r, 100.0 + 5 * ((i * 7 + j) % 11), (i * 3 + j) % 7, (i * 5 + j) % 5, (i * i + j) % 9, (i * 11 + j * i) % 8, 1000000, 5000, 6000, 7000, 800)
        for i, m in enumerate(months)
        for j, r in enumerate(("a", "b"))
    ]
    cols = "month DATE, year INT, region STRING, hum_cases DOUBLE, catt_cases INT, cam_cases INT, goat_cases INT, shp_cases INT, pop INT, catt_pop INT, goat_pop INT, sheep_pop INT, cam_pop INT"
    from panelspark.operators import rows

    ah2 = rows.rate_columns(spark.createDataFrame(data, cols), rollup.RATE_PAIRS)
    national = rows.rate_columns(
        ah2.groupBy("year", "month").agg(*[F.sum(c).alias(c) for c in [*rollup.CASES, *rollup.POPS]]), rollup.RATE_PAIRS
    )
    bundle = {"ah2": ah2, "kenya_ah2": national}
    reg = analyses.regressions(bundle)
    assert reg["coefficients"].count() == 7 * (5 + 2) and reg["forest"].count() == 7 * 5
    assert reg["metrics"].count() == 14 and reg["regional"].count() == 2 * 49 and reg["ranked"].where("place = 1").count() == 2
    assert analyses.correlations(bundle)["average"].count() == 7
    counts = analyses.count_regressions(bundle, lags=(0, 1), region_iterations=2)
    assert counts["by_species"].count() == counts["by_species_linear"].count() == 8
    regions = bundle["ah2"].select("region").distinct().count()
    assert counts["regions"].count() == 2 * regions
    fc = analyses.forecasts(national, history_end="2018-12-01", max_p=2, lags=(0, 1))
    assert fc["comparison"].count() == 2 and fc["by_lag"].count() == 2 and fc["full_forecast"].count() == 12
    assert fc["decomposed"].count() == n and fc["ccf"].count() == 25
