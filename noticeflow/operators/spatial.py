"""Points, lines and map layers; all geometry is Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.status import apply_alpha, confidence, is_problem, lifecycle_bucket
from noticeflow.scratch import Scratch

EARTH_M = 6_371_000.0
#: GRS80 ellipsoid and the transverse Mercator scale of UTM.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257222101, 0.9996, 500_000.0


def to_utm(lon: Column, lat: Column, zone: int = 16) -> tuple[Column, Column]:
    """(easting, northing) in metres by the Krueger series to third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    squash = 2 * n**0.5 / (1 + n)
    phi, away = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - squash * F.atanh(squash * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * radius * x, SCALE * radius * y


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def has_second_point() -> Column:
    return F.col("secondary_latitude").isNotNull() & F.col("secondary_longitude").isNotNull()


def geometry_kind(limit_m: float = 50.0) -> Column:
    """line when both ends exist more than the limit apart, else point; null without coordinates."""
    apart = haversine_m(F.col("latitude"), F.col("longitude"), F.col("secondary_latitude"), F.col("secondary_longitude"))
    return F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), None).when(has_second_point() & (apart > limit_m), "line").otherwise("point")


def midpoint() -> Column:
    return F.struct(((F.col("longitude") + F.col("secondary_longitude")) / 2).alias("x"), ((F.col("latitude") + F.col("secondary_latitude")) / 2).alias("y"))


def circle(lat: Column, lon: Column, radius_m: float = 25.0, vertices: int = 32) -> Column:
    """A closed ring of vertices (x, y) round a point, on a locally flat earth."""
    north = radius_m / 111_320.0
    east = F.lit(north) / F.cos(F.radians(lat))
    angle = lambda i: 2 * F.pi() * F.pmod(i, F.lit(vertices)) / vertices
    return F.transform(F.sequence(F.lit(0), F.lit(vertices)), lambda i: F.struct((lon + east * F.cos(angle(i))).alias("x"), (lat + north * F.sin(angle(i))).alias("y")))


POINTS = "array<array<double>>"


def segments(features: DataFrame, id_col: str = "project_id", geometry: str = "geometry", name: str = "project_name") -> DataFrame:
    """(project_id, project_name, x1, y1, x2, y2): every segment of Line, MultiLine, Polygon and MultiPolygon features.

    `geometry` is GeoJSON text; what can't be read as one of these is left out.
    """
    kind = F.get_json_object(geometry, "$.type")
    raw = F.get_json_object(geometry, "$.coordinates")
    lines = (
        F.when(kind == "LineString", F.array(F.from_json(raw, POINTS)))
        .when(kind.isin("MultiLineString", "Polygon"), F.from_json(raw, f"array<{POINTS}>"))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(raw, f"array<array<{POINTS}>>")))
    )
    parts = features.select(F.col(id_col).alias("project_id"), F.col(name).alias("project_name"), F.explode(lines).alias("p")).where(F.size("p") > 1)
    pairs = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return parts.select("project_id", "project_name", F.inline(pairs)).dropna()


def point_segment_m(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    span = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(span == 0, 0.0).otherwise(((px - x1) * dx + (py - y1) * dy) / F.when(span == 0, 1.0).otherwise(span))))
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def _crossed_cells(lines: DataFrame, width: float) -> DataFrame:
    """The lines with every grid cell (cx, cy) that each crosses: column by column of the grid, not its whole box."""
    cell = lambda c: F.floor(c / F.lit(width))
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = lines.withColumn("cx", F.explode(F.sequence(cell(low), cell(high))))
    span = F.col("x2") - F.col("x1")
    # a sliver more than the line has in the column, so that rounding loses no cell
    at = lambda x: F.when(span == 0, F.lit(None)).otherwise(F.col("y1") + (x - F.col("x1")) / span * (F.col("y2") - F.col("y1")))
    a = F.coalesce(at(F.greatest(low, F.col("cx") * width)), F.col("y1"))
    b = F.coalesce(at(F.least(high, (F.col("cx") + 1) * width)), F.col("y2"))
    sliver = F.lit(width * 1e-6)
    return columns.withColumn("cy", F.explode(F.sequence(cell(F.least(a, b) - sliver), cell(F.greatest(a, b) + sliver))))


#: Segments of a cell at most, before it is parted, and into how many columns and rows.
CELL_SEGMENTS, SPLIT = 64, 8
#: Metres below which no cell is parted.
LEAST_CELL_M = 1.0


def cell_tree(metric: DataFrame, width: float, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(inner cells of each level, with the cells inside that hold segments; leaf cells with their segments).

    A cell of more than CELL_SEGMENTS segments is parted again and again, so
    cells are small where segments lie close and large where there are few.
    """
    here, level, inner, leaves = metric.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")}), 0, [], None
    while True:
        here = scratch.save(here, f"cells-{level}")
        crowded = F.count("*") > (CELL_SEGMENTS if width > LEAST_CELL_M else 2**62)
        cells = scratch.save(here.groupBy("cx", "cy").agg(crowded.alias("crowded")), f"sizes-{level}")
        if level:
            up = [F.floor(F.col(c) / SPLIT).cast("long").alias(c) for c in ("cx", "cy")]
            kids = cells.select(*up, F.struct("cx", "cy", "crowded").alias("kid")).groupBy("cx", "cy").agg(F.collect_list("kid").alias("kids"))  # at most SPLIT**2 a cell
            inner.append(scratch.save(kids, f"inner-{level}"))
        own = here.join(cells.where("NOT crowded"), ["cx", "cy"]).drop("crowded").withColumn("level", F.lit(level))
        leaves = own if leaves is None else leaves.unionByName(own)
        large = cells.where("crowded").select("cx", "cy")
        if large.isEmpty():
            return inner, leaves
        level, width = level + 1, width / SPLIT
        lines = here.join(large, ["cx", "cy"], "left_semi").drop("cx", "cy").distinct()
        place = large.select(F.col("cx").alias("ux"), F.col("cy").alias("uy"))
        finer = _crossed_cells(lines, width).withColumns({"ux": F.floor(F.col("cx") / SPLIT), "uy": F.floor(F.col("cy") / SPLIT)})
        here = finer.join(place, ["ux", "uy"], "left_semi").drop("ux", "uy")


def _reach(x: Column, y: Column, cx: Column, cy: Column, width: float) -> tuple[Column, Column]:
    """(least, greatest) distance from a point to a cell, a sliver wider than it is."""
    sides = []
    for p, c in ((x, cx), (y, cy)):
        low, high = c * width - width * 1e-6, (c + 1) * width + width * 1e-6
        sides.append((F.greatest(low - p, p - high, F.lit(0.0)), F.greatest(F.abs(p - low), F.abs(p - high))))
    return tuple(F.sqrt(a * a + b * b) for a, b in zip(*sides))


def _nearest(points: DataFrame, lines: DataFrame, zone: int) -> DataFrame:
    """(longitude, latitude, project_id, project_name, distance_m) of every distinct place of the points that has a nearest segment."""
    scratch = Scratch(points.sparkSession, "nearest")
    real = lambda *cols: " AND ".join(f"abs({c}) < 1e9" for c in cols)  # noqa: E731  false for NaN, which is beyond every number
    x, y = to_utm(F.col("longitude"), F.col("latitude"), zone)
    spots = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("longitude", "latitude").distinct()
    # the projection is worked out once a place: a filter on it would be pushed below the distinct, to every row
    left = scratch.save(spots.select("longitude", "latitude", x.alias("px"), y.alias("py")), "points").where(real("px", "py"))
    a, b = to_utm(F.col("x1"), F.col("y1"), zone), to_utm(F.col("x2"), F.col("y2"), zone)
    metric = lines.select("project_id", "project_name", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    metric = scratch.save(metric, "lines").where(real("x1", "y1", "x2", "y2"))
    metric = scratch.save(metric.groupBy("x1", "y1", "x2", "y2").agg(F.min(F.struct("project_id", "project_name")).alias("project")), "segments")
    box = metric.agg(*[f(g(p, q)) for p, q in (("x1", "x2"), ("y1", "y2")) for f, g in ((F.min, F.least), (F.max, F.greatest))]).first()
    if box[0] is None:
        return left.limit(0).select("longitude", "latitude", F.lit(None).cast(lines.schema["project_id"].dataType).alias("project_id"), F.lit(None).cast("string").alias("project_name"), F.lit(0.0).alias("distance_m"))
    width = 1.01 * max(box[1] - box[0], box[3] - box[2], LEAST_CELL_M)
    shift = {c: F.col(c) - F.lit(box[0 if "x" in c else 2]) for c in ("x1", "y1", "x2", "y2")}
    inner, leaves = cell_tree(metric.withColumns(shift), width, scratch)
    key = ["longitude", "latitude"]
    here = left.withColumns({"px": F.col("px") - box[0], "py": F.col("py") - box[2], "level": F.lit(0), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long"), "crowded": F.lit(bool(inner)), "near": F.lit(0.0)})
    columns = [*key, "px", "py", "level", "cx", "cy", "crowded", "near"]
    for level, cells in enumerate(inner, 1):
        width /= SPLIT
        reach = lambda kid, width=width: _reach(F.col("px"), F.col("py"), kid["cx"], kid["cy"], width)
        low = here.where(f"crowded AND level = {level - 1}").drop("crowded", "near", "level").join(cells, ["cx", "cy"])
        low = low.withColumn("kids", F.transform("kids", lambda kid: F.struct(kid["cx"].alias("cx"), kid["cy"].alias("cy"), kid["crowded"].alias("crowded"), reach(kid)[0].alias("near"), reach(kid)[1].alias("far"))))
        # the cells of one parent bound each other before they become rows
        low = low.withColumn("bound", F.array_min(F.col("kids.far"))).select(*key, "px", "py", F.explode(F.filter("kids", lambda kid: kid["near"] <= F.col("bound"))).alias("kid"))
        low = low.select(*key, "px", "py", F.lit(level).alias("level"), "kid.cx", "kid.cy", "kid.crowded", "kid.near", "kid.far")
        # what was found on other ways bounds it, too
        both = here.where(f"NOT crowded OR level < {level - 1}").withColumn("far", F.lit(float("inf"))).select(*columns, "far").unionByName(low)
        here = both.withColumn("far", F.min("far").over(Window.partitionBy(*key))).where("near <= far").select(*columns)
    d = point_segment_m(*map(F.col, ("px", "py", "x1", "y1", "x2", "y2")))
    met = here.join(leaves, ["level", "cx", "cy"]).select(*key, F.struct(d.alias("d"), "project").alias("m"))
    best = met.groupBy(*key).agg(F.min("m").alias("m"))
    return scratch.save(best.select(*key, "m.project.project_id", "m.project.project_name", F.col("m.d").alias("distance_m")), "best")


def _at_places(rows: DataFrame, near: DataFrame, how: str, key: str) -> DataFrame:
    """The rows with what is nearest to their place; places that very many rows share, and rows without one, are spread."""
    spot = F.xxhash64("longitude", "latitude")
    located = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    left = rows.withColumn("__spread", F.when(located, spot).otherwise(F.xxhash64(key)))
    right = near.select(F.col("longitude").alias("__x"), F.col("latitude").alias("__y"), spot.alias("__at"), *near.columns[2:])
    on = (F.col("longitude") == F.col("__x")) & (F.col("latitude") == F.col("__y")) & (F.col("__spread") == F.col("__at"))
    return left.join(right, on, how).drop("__spread", "__x", "__y", "__at")


def nearest_line(points: DataFrame, lines: DataFrame, key: str, zone: int = 16) -> DataFrame:
    """(key, project_id, project_name, distance_m): the nearest segment of each located point, of equally near ones the smallest id.

    Branch and bound over cells that are as dense as the segments (cell_tree): a
    point goes down from the cell of all data; at each level the farthest corner
    of the cells it may still choose bounds its distance, and cells that begin
    beyond the bound are passed over.  In the end it meets the few leaf cells
    that are left, of at most CELL_SEGMENTS segments each, however far it is from
    every line and however close the lines lie.  Points of one place are one, and
    so are segments of equal geometry.  There is no cross join, and segments are
    never broadcast by hand; a cell that very many points share is split by AQE.
    Points and segments whose coordinates are null, NaN or beyond the projection
    are left out; an empty side gives an empty result.
    """
    near = _nearest(points, lines, zone)
    located = points.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.col(key), "longitude", "latitude")
    return _at_places(located, near, "inner", key).select(key, "project_id", "project_name", "distance_m")


def match_projects(tickets: DataFrame, lines: DataFrame, key: str = "ticket_number", zone: int = 16) -> DataFrame:
    """Add project_name (null beyond low confidence), match_confidence and match_distance_m (kept at any distance, two decimals)."""
    near = _nearest(tickets, lines, zone).select("longitude", "latitude", F.col("project_name").alias("__name"), "distance_m")
    joined = _at_places(tickets, near, "left", key)
    tier = F.when(F.col("distance_m").isNull(), "none").otherwise(confidence(F.col("distance_m")))
    return joined.withColumns({"match_confidence": tier, "match_distance_m": F.bround("distance_m", 2)}).withColumn(
        "project_name", F.when(F.col("match_confidence") != "none", F.col("__name"))
    ).drop("__name", "distance_m")


def match_places(tickets: DataFrame, lines: DataFrame, zone: int = 16) -> DataFrame:
    """(longitude, latitude, n, project_name, match_confidence, match_distance_m) of every distinct place, with the n tickets there.

    The tickets are read once; rows without a place are counted, too.
    """
    places = tickets.groupBy("longitude", "latitude").agg(F.count("*").alias("n"))
    places = Scratch(tickets.sparkSession, "places").save(places, "places")
    return match_projects(places, lines, "n", zone)


#: Colours (alpha, blue, green, red) of layers and of the stages of projects.
GRAY, PURPLE = "ff808080", "ff800080"
STAGE_COLORS = {"active": "ff008000", "committed": "ffff0000", "recent": GRAY}
CONFLICT_ALPHA, NAME_LENGTH = 0.40, 60


def map_layers(view: DataFrame, axes: dict[str, Column], today: Column, colors: dict[str, Column] | None = None, other: Column | None = None) -> DataFrame:
    """Shapes of the map: every active located row once per axis, its dig circle if it is a point, and rows cancelled in 14 days.

    `other` marks rows of the contractor that are not relevant: they are in a
    layer of their own and in no other.  `colors` gives the colour of an axis.
    """
    located = view.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("kind", geometry_kind())
    apart = F.coalesce(other, F.lit(False)) if other is not None else F.lit(False)
    active = ~F.coalesce("is_cancelled", F.lit(False)) & ~apart
    entry = lambda layer, bucket, kind: F.struct(F.lit(layer).alias("layer"), bucket.alias("bucket"), kind.alias("shape"))
    rows = [F.when(active, entry(name, bucket, F.col("kind"))) for name, bucket in axes.items()]
    rows.append(F.when(active & (F.col("kind") == "point"), entry("circles", F.lit("dig zone"), F.lit("circle"))))
    gone = F.coalesce(F.col("is_cancelled") & (F.col("call_date") >= F.date_sub(today, 14)), F.lit(False)) & ~apart
    rows.append(F.when(gone, entry("cancelled_14d", F.lit("cancelled"), F.col("kind"))))
    rows.append(F.when(apart, entry("contractor_other", F.lit("not relevant"), F.col("kind"))))
    out = located.select("*", F.inline(F.array_compact(F.array(*rows))))
    ring = F.when(F.col("shape") == "circle", circle(F.col("latitude"), F.col("longitude")))
    line = F.when(F.col("shape") == "line", F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")), F.struct(F.col("secondary_longitude").alias("x"), F.col("secondary_latitude").alias("y"))))
    point = F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y")))
    color = F.when(F.col("layer") == "contractor_other", PURPLE)
    for name, shown in (colors or {}).items():
        color = color.when(F.col("layer") == name, shown)
    return out.select(
        "layer", "bucket", "shape", "ticket_number", F.col("ticket_number").alias("name"), color.otherwise(GRAY).alias("color"),
        is_problem(F.col("has_late_utility"), F.col("blocking_utility_codes")).alias("caution"), F.coalesce(ring, line, point).alias("vertices"),
    )


def feature_layers(features: DataFrame, counts: DataFrame, bucket: Column, layer: str) -> DataFrame:
    """Map features with the counts of their tickets."""
    joined = features.join(counts, "project_name", "left")
    return joined.select(F.lit(layer).alias("layer"), bucket.alias("bucket"), "project_id", "project_name", F.coalesce("total", F.lit(0)).alias("tickets"), "geometry")


def _drawable() -> Column:
    return F.get_json_object("geometry", "$.type").isin("LineString", "MultiLineString", "Polygon", "MultiPolygon") & (
        F.coalesce(F.get_json_object("geometry", "$.coordinates"), F.lit("[]")) != "[]"
    )


def _feature_name() -> Column:
    return F.left(F.coalesce(F.nullif("project_name", F.lit("")), F.concat(F.lit("Project "), F.col("project_id").cast("string"))), F.lit(NAME_LENGTH))


def package_layers(features: DataFrame, counts: DataFrame, today: Column) -> DataFrame:
    """Projects by their stage (active, committed, recent) with a colour, a name and the counts of their tickets; only what can be drawn."""
    stage = lifecycle_bucket(F.col("status"), F.col("act_end_date"), today)
    rows = feature_layers(features.where(_drawable()), counts, stage, "packages")
    color = F.coalesce(*[F.when(F.col("bucket") == k, F.lit(v)) for k, v in STAGE_COLORS.items()])
    return rows.withColumns({"color": color, "name": _feature_name()})


def conflict_layer(features: DataFrame) -> DataFrame:
    """Other owners' projects as one subdued layer; only what can be drawn."""
    return features.where(_drawable()).select(
        F.lit("conflict").alias("layer"), F.coalesce("owner", F.lit("")).alias("bucket"), "project_id", _feature_name().alias("name"),
        apply_alpha(F.lit(GRAY), CONFLICT_ALPHA).alias("color"), "geometry",
    )
