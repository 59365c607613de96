"""Reference points of the proximity test that need no file, and where a file of fault traces is looked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Places on plate boundaries (latitude, longitude), one to a stretch, rounded to a degree: a coarse stand-in for traces.
PLATE_BOUNDARY = (
    (36, -121), (19, -105), (12, -88), (3, -79), (-12, -78), (-23, -71), (-36, -74), (-52, -75), (-56, -30), (52, -172), (58, -152), (52, 160), (43, 147), (38, 143),
    (30, 131), (24, 122), (12, 126), (2, 126), (-6, 105), (-9, 118), (-6, 148), (-11, 162), (-20, -174), (-41, 177), (28, 84), (36, 71), (34, 47), (39, 35), (37, 22),
    (64, -20), (30, -42), (0, -25), (-38, -17), (-35, 54), (-45, 96), (-63, 170), (12, 45), (-5, 68), (-4, -104), (-36, -110),
)


def plate_boundary(spark: SparkSession) -> DataFrame:
    """(latitude, longitude) of PLATE_BOUNDARY."""
    return spark.createDataFrame([(float(y), float(x)) for y, x in PLATE_BOUNDARY], "latitude double, longitude double")


def first_existing(*paths: str | None) -> str | None:
    """The first of the paths that is there (a harmonised file is named before a raw one); None if none is."""
    return next((p for p in paths if p and os.path.exists(p)), None)
