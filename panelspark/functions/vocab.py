"""Label vocabularies.

FIXED VALUES: the spellings below are input data conventions of the case-report
files and have to be equal to them for results to agree.
"""

from __future__ import annotations

# FIXED VALUES: species spellings, four passes applied in this order; None means missing.
SPECIES_PASSES: list[dict[str, str | None]] = [
    {
        "Bobine": "Bovine",
        "Bufallo": "Buffalo",
        "Cani": "Canine",
        "Canine(Jackal)": "Canine",
        "Cannine": "Canine",
        "Dog": "Canine",
        "Dogs": "Canine",
        "Goat": "Goats",
        "": None,
        "Nd": None,
    },
    {
        "Bovine & Canine": "Canine",
        "Caprine/Ovine": "Caprine",
        "Caprine+Donkey": "Caprine",
        "Dogs/Donkey": "Dogs",
        "Canine, Feline": "Dogs",
        "Dogs, Cats": "Dogs",
    },
    {
        "Camelidae": "Camel",
        "Goats": "Caprine",
        "Cats": "Feline",
        "Dogs": "Canine",
        "Sheep": "Ovine",
        "Pig": "Porcine",
        "Donkey": "Equine",
        "Cattle": "Bovine",
        "Pigs": "Porcine",
        "White Tailed Mongoose": "Mongoose",
    },
    {
        "Camel": "Camels",
        "Bovine": "cattle",
        "Equine": "Donkeys",
        "Caprine": "Goats",
        "Porcine": "Pigs",
        "Ovine": "Sheep",
    },
]

# FIXED VALUES: diagnosis spellings; every other value, and null, is clinical.
CLINICAL = "Clinically confirmed"
LAB = "Lab confirmed"
POST_MORTEM = "Post Mortem"
DIAGNOSES = [CLINICAL, LAB, POST_MORTEM]
DIAGNOSIS_MAP = {
    "Clinical Signs/Lab": LAB,
    "Lab": LAB,
    "Lab Diagnosis": LAB,
    "Laboratory": LAB,
    "Pm &Lb": LAB,
    "Pm": POST_MORTEM,
    "Postmortem": POST_MORTEM,
    "Post Mortem": POST_MORTEM,
}

# FIXED VALUES: region spellings of the case reports.
REGION_MAP = {
    "Elgeiyo Marakwet": "Elgeyo Marakwet",
    "Elgeyo/Marakwet": "Elgeyo Marakwet",
    "Kaimbu": "Kiambu",
    "Karatina": "Nyeri",
    "Murang?": "Murang'a",
    "Murang�": "Murang'a",
    "Mwingi": "Kitui",
    "Sotik": "Bomet",
    "Tharaka-Nithi": "Tharaka Nithi",
    "Trans-Nzoia": "Trans Nzoia",
    "Pokot": "West Pokot",
}

# FIXED VALUES: region spellings of the census tables.
CENSUS_REGION_MAP = {
    "Elgeyo/Marakwet": "Elgeyo Marakwet",
    "Nairobi City": "Nairobi",
    "Taita/Taveta": "Taita Taveta",
    "Tharaka-Nithi": "Tharaka Nithi",
}

# FIXED VALUES: region spellings of the map layer.
MAP_REGION_MAP = {
    "Elgeyo Marakwet": "Elgeyo-Marakwet",
    "Tharaka Nithi": "Tharaka-Nithi",
}

# FIXED VALUES: rows of the older projection sheet that are not regions.
PROJECTION_AGGREGATES = [
    "Kenya",
    "Central",
    "Coast",
    "Eastern",
    "Western",
    "N. Eastern",
    "Nyanza",
    "R. Valley",
]

# FIXED VALUES: the disease of interest and the pattern that finds it.
DISEASE = "Brucellosis"
DISEASE_PATTERN = "(?i)brucellosis|brucella"

# FIXED VALUES: short series names, their report labels, their display names.
SERIES = ["hum", "catt", "cam", "goat", "shp"]
ANIMALS = ["catt", "cam", "goat", "shp"]
SPECIES_TO_SERIES = {"cattle": "catt", "Camels": "cam", "Goats": "goat", "Sheep": "shp"}
SERIES_DISPLAY = {
    "hum": "Human",
    "catt": "Cattle",
    "cam": "Camel",
    "goat": "Goat",
    "shp": "Sheep",
}
TERM_DISPLAY = {
    "goat_incidence": "Goat Incidence",
    "catt_incidence": "Cattle incidence",
    "shp_incidence": "Sheep incidence",
    "cam_incidence": "Camel incidence",
    "animal_incidence": "Total animal incidence",
}
POPULATION_OF = {
    "hum": "pop",
    "catt": "catt_pop",
    "cam": "cam_pop",
    "goat": "goat_pop",
    "shp": "sheep_pop",
}

# FIXED VALUES: outlier limits of the monthly region panel (column, limit, comparison).
OUTLIER_LIMITS = [("catt_cases", 69, ">="), ("goat_cases", 28, ">"), ("shp_cases", 12, ">")]


def fold_passes(passes: list[dict[str, str | None]]) -> dict[str, str | None]:
    """One mapping with the same effect as applying ``passes`` one after another."""
    folded: dict[str, str | None] = {}
    for label in [key for step in passes for key in step]:
        value: str | None = label
        for step in passes:
            if value is not None:
                value = step.get(value, value)
        if value != label:
            folded[label] = value
    return folded


SPECIES_MAP = fold_passes(SPECIES_PASSES)
