"""CSV sources with fixed text schemas; numbers and dates are parsed by the operators."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from casegrid.operators.ranking import top_cities
from casegrid.sources import fs

# Header names of the accepted CSV files.
CSV_COLUMNS = {
    "conditions": ["START", "STOP", "PATIENT", "ENCOUNTER", "CODE", "DESCRIPTION"],
    "patients": [
        "Id", "FIRST", "LAST", "GENDER", "BIRTHDATE", "ADDRESS", "CITY", "STATE", "ZIP", "LAT", "LON",
    ],
    "encounters": ["Id", "START", "STOP", "ENCOUNTERCLASS", "CODE", "DESCRIPTION"],
    "worldcities": ["city", "country", "iso2", "lat", "lng", "population"],
}


def read_csv(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """Header CSV as text columns, found by header name in every file, in any order.

    Files with equal headers are read together. ``multi_line`` accepts line breaks inside quotes, for
    which a file is read by one task; turn it off for large files without them.
    """
    wanted = CSV_COLUMNS[kind]
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in fs.files(spark, path):
        header = tuple(next(csv.reader([fs.first_line(spark, name).lstrip("\ufeff")]), []))
        if header:
            by_header.setdefault(header, []).append(name)
    frames = []
    for header, names in by_header.items():
        missing = [c for c in wanted if c not in header]
        if missing:
            raise ValueError(f"{names[0]}: no column {', '.join(missing)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        reader = spark.read.option("header", True).option("escape", "\"").option("multiLine", multi_line).schema(schema)
        frames.append(reader.csv(names).select(*wanted))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in wanted]))
    return reduce(DataFrame.unionByName, frames)


def read_cities(spark: SparkSession, path: str, max_cities: int, min_population: int) -> DataFrame:
    """The most populous cities of a city file; unreadable rows are left out."""
    return top_cities(read_csv(spark, path, "worldcities"), max_cities, min_population)
