"""Distance-based merging of hotspots at a zoom level.

Points are ``condition_code, h3, lat, lon, cases`` and optionally ``original_cases, latest_date,
days_with_cases, condition_display``. Points that come from a cell-binned fact are at most
``geo.cell_count(resolution)`` per condition, however many events lie behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegrid.functions import geo, severity
from casegrid.operators.components import connected_components
from casegrid.session import cut_lineage

COORDINATE_DIGITS = 8
_SPHERE_KM_PER_DEGREE = 111.2
# Parts of a tile's height and width, for tile pairs that their extents leave undecided.
_PARTS = 4
# Relative slack of the bounds, far above what doubles lose.
_SLACK = 1e-9


def collapse_coordinates(points: DataFrame) -> DataFrame:
    """One point per coordinate (to eight decimals): cases summed, the other measures maximised."""
    have = set(points.columns)
    pick = lambda name, other: F.col(name) if name in have else other
    key = [F.round(c, COORDINATE_DIGITS).alias(f"_{c}") for c in ("lat", "lon")]
    return (
        points.groupBy("condition_code", *key)
        .agg(
            F.min("h3").alias("h3"),
            F.min("lat").alias("lat"),
            F.min("lon").alias("lon"),
            F.sum("cases").alias("cases"),
            F.max(F.coalesce(pick("original_cases", F.col("cases")), F.col("cases"))).alias("original_cases"),
            F.count("*").alias("merged_count"),
            F.max(pick("days_with_cases", F.lit(1).cast("bigint"))).alias("days_with_cases"),
            F.max(pick("latest_date", F.lit(None).cast("string"))).alias("latest_date"),
        )
        .drop("_lat", "_lon")
    )


def _longitude_buckets(band: Column, threshold_km: float) -> Column:
    """Number of equal longitude buckets of a latitude band, none narrower than the longitude limit."""
    height = threshold_km / geo.KM_PER_LAT_DEGREE
    low = band * height - 90.0
    steepest = F.least(F.lit(90.0), F.greatest(F.abs(low), F.abs(low + height)))
    width = F.least(F.lit(180.0), F.lit(threshold_km) / geo.km_per_lon_degree(steepest))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / width).cast("int"))


def _bucket(lon: Column, buckets: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * buckets).cast("int"), buckets)


def _radius_km(zoom: float) -> Column:
    return severity.radius_m(F.col("cases"), zoom) / 1000.0


def _grid_sides(side: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Rows looking for partners and rows offered, by ``band`` and ``bucket`` of the grid."""
    band = F.floor((F.col("lat") + 90.0) / (limit / geo.KM_PER_LAT_DEGREE)).cast("int")
    side = side.withColumn("band", band)
    count = _longitude_buckets(F.col("band"), limit)
    home = _bucket(F.col("lon"), count)
    around = F.array_distinct(F.array(home, F.pmod(home + 1, count), F.pmod(home - 1, count)))
    a = side.select("*", F.explode(around).alias("bucket"))
    b = side.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") - 1))).withColumn(
        "bucket", _bucket(F.col("lon"), _longitude_buckets(F.col("band"), limit))
    )
    return a, b


def near_pairs(points: DataFrame, zoom: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs ``a``, ``b`` of one condition that may merge at the zoom level, with their distance.

    ``a`` is the lower one by (lat, h3). A pair qualifies inside the latitude and longitude limits and
    within max(base threshold, sum of both radii). Candidates meet by an equi-join on a grid whose
    buckets are at least as wide as the limits: ``a`` looks in its own and both neighbouring longitude
    buckets, ``b`` is offered to its own latitude band and the one below. Each pair meets once.
    Columns named in ``carry`` come along for both sides.
    """
    limit, base = severity.max_threshold_km(zoom), severity.base_threshold_km(zoom)
    max_lat = limit / geo.KM_PER_LAT_DEGREE
    a, b = _grid_sides(points.select("condition_code", "h3", "lat", "lon", "cases", *carry, _radius_km(zoom).alias("radius_km")), limit)
    keys = ["condition_code", "band", "bucket"]
    measures = ["h3", "lat", "lon", "cases", "radius_km", *carry]
    rename = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in measures])
    pairs = rename(a, "a").join(rename(b, "b"), keys)
    ordered = (F.col("a_lat") < F.col("b_lat")) | ((F.col("a_lat") == F.col("b_lat")) & (F.col("a_h3") < F.col("b_h3")))
    lon_limit = F.least(F.lit(180.0), F.lit(limit) / geo.km_per_lon_degree(F.col("a_lat")))
    distance = geo.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return (
        pairs.where(ordered & (F.col("b_lat") - F.col("a_lat") <= max_lat))
        .where(geo.longitude_gap(F.col("a_lon"), F.col("b_lon")) <= lon_limit)
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= F.greatest(F.lit(base), F.col("a_radius_km") + F.col("b_radius_km")))
        .drop("band", "bucket", "a_radius_km", "b_radius_km")
    )


def _tile(zoom: float, parts: int = 1) -> Column:
    """Id of a tile so small that any two points in it are within the base threshold; or of a part of such a tile."""
    half = severity.base_threshold_km(zoom) / 2 / parts
    height = half / _SPHERE_KM_PER_DEGREE
    row = F.floor((F.col("lat") + 90.0) / height)
    low = row * height - 90.0
    # The widest parallel of the row bounds the east-west distance inside the tile.
    flattest = F.when(F.signum(low) * F.signum(low + height) <= 0, 0.0).otherwise(
        F.least(F.abs(low), F.abs(low + height))
    )
    width = F.lit(half) / F.greatest(
        F.lit(geo.MIN_KM_PER_LON_DEGREE), F.cos(F.radians(flattest)) * _SPHERE_KM_PER_DEGREE
    )
    column = F.floor((F.col("lon") + 180.0) / width)
    return F.concat_ws("|", "condition_code", row.cast("string"), column.cast("string"))


def _boxes(tiled: DataFrame, *keys: str) -> DataFrame:
    """What bounds the distances of a tile's points: its extent, radii, and cosines of latitude."""
    least, most = F.min("lat"), F.max("lat")
    flattest = F.when(F.signum(least) * F.signum(most) <= 0, 0.0).otherwise(F.least(F.abs(least), F.abs(most)))
    return tiled.groupBy(*keys).agg(
        least.alias("south"), most.alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min("radius_km").alias("least_radius"), F.max("radius_km").alias("most_radius"),
        F.cos(F.radians(flattest)).alias("most_cos"),
        F.least(F.cos(F.radians(least)), F.cos(F.radians(most))).alias("least_cos"),
    )


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _decided(pairs: DataFrame, zoom: float) -> DataFrame:
    """``touches`` for pairs ``l_*, r_*`` of boxes: true if all their points are near, NULL if some may be; others go.

    Great-circle distance grows with the gap in latitude, the gap in longitude and the cosines, so the
    extremes of these bound it. The bounds give way by one part in a billion, for rounding.
    """
    limit, base = severity.max_threshold_km(zoom), severity.base_threshold_km(zoom)
    max_lat = limit / geo.KM_PER_LAT_DEGREE
    low = lambda a, b: F.greatest(F.lit(0.0), F.greatest(f"l_{a}", f"r_{a}") - F.least(f"l_{b}", f"r_{b}"))
    high = lambda a, b: F.greatest(f"l_{b}", f"r_{b}") - F.least(f"l_{a}", f"r_{a}")
    round_trip = lambda gap: F.least(gap, F.lit(360.0) - gap)
    lat_low, lat_high, lon_low, lon_high = low("south", "north"), high("south", "north"), low("west", "east"), high("west", "east")
    gap_low = F.least(round_trip(lon_low), round_trip(lon_high))
    gap_high = F.when((lon_low <= 180) & (lon_high >= 180), 180.0).otherwise(F.greatest(round_trip(lon_low), round_trip(lon_high)))

    def km(lat_gap, cosines, lon_gap):
        h = F.pow(F.sin(F.radians(lat_gap) / 2), 2) + cosines * F.pow(F.sin(F.radians(lon_gap) / 2), 2)
        return 2 * geo.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    def lon_limit(cosine):
        return F.least(F.lit(180.0), limit / F.greatest(F.lit(geo.MIN_KM_PER_LON_DEGREE), geo.KM_PER_LON_DEGREE * cosine))

    nearest = km(lat_low, F.col("l_least_cos") * F.col("r_least_cos"), gap_low) * (1 - _SLACK)
    farthest = km(lat_high, F.col("l_most_cos") * F.col("r_most_cos"), gap_high) * (1 + _SLACK)
    reach = lambda which: F.greatest(F.lit(base), F.col(f"l_{which}_radius") + F.col(f"r_{which}_radius"))
    all_near = (
        (farthest <= reach("least")) & (lat_high <= max_lat * (1 - _SLACK))
        & (gap_high <= lon_limit(F.greatest("l_most_cos", "r_most_cos")) * (1 - _SLACK))
    )
    some_near = (
        (nearest <= reach("most")) & (lat_low <= max_lat * (1 + _SLACK))
        & (gap_low <= lon_limit(F.least("l_least_cos", "r_least_cos")) * (1 + _SLACK))
    )
    return pairs.withColumn("touches", F.when(all_near, True)).where(all_near | some_near)


def _points_meet(zoom: float) -> Column:
    """The test of :func:`near_pairs` for points ``l_*, r_*`` in any order."""
    limit, base = severity.max_threshold_km(zoom), severity.base_threshold_km(zoom)
    south = F.least("l_lat", "r_lat")
    return (
        (F.abs(F.col("l_lat") - F.col("r_lat")) <= limit / geo.KM_PER_LAT_DEGREE)
        & (geo.longitude_gap(F.col("l_lon"), F.col("r_lon")) <= F.least(F.lit(180.0), F.lit(limit) / geo.km_per_lon_degree(south)))
        & (
            geo.haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
            <= F.greatest(F.lit(base), F.col("l_radius_km") + F.col("r_radius_km"))
        )
    )


def touching_tiles(points: DataFrame, zoom: float) -> DataFrame:
    """Pairs ``src, dst`` of tiles of which some points are near; ``points`` carry ``_tile``. Runs jobs.

    Tiles that meet in the grid are decided by the bounds of their extents where these suffice, else by
    those of their parts, and only points of parts that are still undecided are compared, each until
    it has found one partner.
    """
    limit = severity.max_threshold_km(zoom)
    placed = points.select("condition_code", "lat", "lon", "_tile", _tile(zoom, _PARTS).alias("_part"), _radius_km(zoom).alias("radius_km"))
    entries = placed.select("condition_code", "lat", "lon", "_tile")
    a, b = (side.select("condition_code", "band", "bucket", "_tile").distinct() for side in _grid_sides(entries, limit))
    keys = ["condition_code", "band", "bucket"]
    met = a.withColumnRenamed("_tile", "a").join(b.withColumnRenamed("_tile", "b"), keys).where("a <> b")
    met = met.select(F.least("a", "b").alias("l__tile"), F.greatest("a", "b").alias("r__tile")).distinct()
    boxes = _boxes(placed, "_tile")
    whole = cut_lineage(
        _decided(met.join(_side(boxes, "l"), "l__tile").join(_side(boxes, "r"), "r__tile"), zoom).select("l__tile", "r__tile", "touches")
    )
    parts = _boxes(placed, "_tile", "_part")
    open_pairs = whole.where("touches is null").select("l__tile", "r__tile")
    split = cut_lineage(
        _decided(open_pairs.join(_side(parts, "l"), "l__tile").join(_side(parts, "r"), "r__tile"), zoom)
        .select("l__tile", "r__tile", "l__part", "r__part", "touches")
    )
    by_parts = split.where("touches").select("l__tile", "r__tile").distinct()
    rest = split.where("touches is null").join(by_parts, ["l__tile", "r__tile"], "left_anti").drop("touches")
    left, right = (_side(placed.drop("condition_code"), s) for s in "lr")
    found = rest.join(left, ["l__tile", "l__part"]).alias("x").join(
        right.alias("y"),
        (F.col("x.r__tile") == F.col("y.r__tile")) & (F.col("x.r__part") == F.col("y.r__part")) & _points_meet(zoom),
        "left_semi",
    )
    edges = whole.where("touches").select("l__tile", "r__tile").unionByName(by_parts).unionByName(found.select("l__tile", "r__tile"))
    return edges.select(F.col("l__tile").alias("src"), F.col("r__tile").alias("dst")).distinct()


def hotspot_components(points: DataFrame, zoom: float) -> DataFrame:
    """Assigns ``component`` (its smallest h3) to every collapsed point: single-linkage over near pairs.

    Points of one tile are connected by construction, so the graph has tiles as nodes. Radii are taken
    before merging, so the result has no order dependence.
    """
    tiled = points.withColumn("_tile", _tile(zoom))
    labels = connected_components(touching_tiles(tiled, zoom))
    rooted = tiled.join(labels, tiled["_tile"] == labels["node"], "left").withColumn(
        "_root", F.coalesce("component", "_tile")
    )
    smallest = rooted.groupBy("_root").agg(F.min("h3").alias("component"))
    return rooted.drop("component", "node", "_tile").join(smallest, "_root").drop("_root")


def merge_hotspots(points: DataFrame, zoom: float) -> DataFrame:
    """One row per component: weighted centre, summed cases, maxima, number of members.

    The centre weighs longitudes on the side of the antimeridian the component is on. The collapsed
    points, at most one per cell and condition, are checkpointed: pairs and members both need them.
    """
    members = hotspot_components(cut_lineage(collapse_coordinates(points)), zoom)
    weight = severity.center_weight(F.col("cases"))
    east = F.when(F.col("lon") < 0, F.col("lon") + 360.0).otherwise(F.col("lon"))
    mean = lambda c: F.sum(c * weight) / F.sum(weight)
    crosses = F.max("lon") - F.min("lon") > 180.0
    centre = F.when(crosses, mean(east)).otherwise(mean(F.col("lon")))
    return (
        members.groupBy("condition_code", "component")
        .agg(
            mean(F.col("lat")).alias("lat"),
            centre.alias("lon"),
            F.sum("cases").alias("cases"),
            F.max("original_cases").alias("original_cases"),
            F.max("days_with_cases").alias("days_with_cases"),
            F.max("latest_date").alias("latest_date"),
            F.count("*").alias("merged_count"),
        )
        .withColumn("lon", F.when(F.col("lon") > 180.0, F.col("lon") - 360.0).otherwise(F.col("lon")))
        .withColumnRenamed("component", "h3")
    )
