"""Edge lists (src, dst, w) between regions. A missing edge weighs 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow import constants as K
from regionflow.constants import EARTH_RADIUS_KM
from regionflow.functions.geo import air_weight, gravity_weight, haversine_km
from regionflow.operators.skew import key_of, stored
from regionflow.sources.tables import rows_to_df

#: Places in a part of a cell, and pairs of places that a task compares.
CELL_ROWS, TASK_PAIRS = 2048, 20_000_000


def pairs_ne(links: DataFrame) -> DataFrame:
    """The distinct ordered pairs of a link table whose ends differ.

    Pairs come from recorded links, never from entities times entities.
    """
    return links.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def pair_attribute(
    pairs: DataFrame, attribute: DataFrame, name: str = "mul", default: float = 1.0
) -> DataFrame:
    """Adds a pair's attribute, or `default` where none is recorded."""
    found = attribute.select("src", "dst", F.col(name).alias("_found"))
    return (
        pairs.join(found, ["src", "dst"], "left")
        .withColumn(name, F.coalesce("_found", F.lit(default)))
        .drop("_found")
    )


def attach_ends(pairs: DataFrame, entities: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `columns` of both ends, prefixed src_ and dst_."""
    for end in ("src", "dst"):
        side = entities.select(
            F.col("entity").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]
        )
        pairs = pairs.join(side, end)
    return pairs


def with_distance(pairs: DataFrame) -> DataFrame:
    ends = [F.col(c) for c in ("src_lat", "src_lon", "dst_lat", "dst_lon")]
    return pairs.withColumn("km", haversine_km(*ends))


def gravity_edges(
    entities: DataFrame,
    links: DataFrame,
    multipliers: DataFrame | None = None,
    a: float = 0.2,
    b: float = 1.0,
    g: float = 1.2,
    k: float = 1e-6,
    cap: float | None = 0.12,
) -> DataFrame:
    """Gravity weights of the linked pairs, each source's sum held to `cap`."""
    pairs = with_distance(attach_ends(pairs_ne(links), entities, ["pop", "lat", "lon"]))
    if multipliers is None:
        pairs = pairs.withColumn("mul", F.lit(1.0))
    else:
        pairs = pair_attribute(pairs, multipliers)
    w = gravity_weight(F.col("src_pop"), F.col("dst_pop"), F.col("km"), F.col("mul"), a, b, g, k)
    edges = pairs.select("src", "dst", w.alias("w"))
    return edges if cap is None else cap_rows(edges, cap)


def gravity_air_edges(
    entities: DataFrame,
    links: DataFrame,
    alpha: float = 1.0,
    beta: float = 1.0,
    gamma: float = 1.6,
    air_blend: float = 0.5,
    step: int = 0,
) -> DataFrame:
    """Airport and gravity weights of the linked pairs.

    `entities` carries entity, pop, lat, lon, airports, air_scale and the
    profile columns connectivity, gdp, mobility and climate.
    """
    used = ["pop", "airports", "air_scale", "connectivity", "gdp", "mobility", "climate"]
    pairs = with_distance(attach_ends(pairs_ne(links), entities, ["lat", "lon", *used]))
    ends = [{c: F.col(f"{end}_{c}") for c in used} for end in ("src", "dst")]
    w = air_weight(*ends, F.col("km"), alpha, beta, gamma, air_blend, step)
    return pairs.select("src", "dst", w.alias("w"))


def outbound_sums(edges: DataFrame, keys: Sequence[str] = ("src",)) -> DataFrame:
    """Sum of the weights leaving each source; the diagonal does not count."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(*keys)
        .agg(F.greatest(F.lit(0.0), F.sum("w")).alias("out_w"))
    )


def _with_sums(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds `_sum`, the weights of a row's key; edges without a source are summed as one more source."""
    placed = edges.withColumn("_at", key_of(keys))
    return placed.join(placed.groupBy("_at").agg(F.sum("w").alias("_sum")), "_at").drop("_at")


def normalize_outbound(edges: DataFrame, rate: float, keys: Sequence[str] = ("src",)) -> DataFrame:
    """Each source's weights scaled to sum to `rate`; all 0 if they sum to 0 or less.

    The sums are made before any shuffle and joined back, so no source's edges
    are gathered in one task.
    """
    scaled = F.when(F.col("_sum") > 0, F.col("w") * (F.lit(rate) / F.col("_sum"))).otherwise(0.0)
    return _with_sums(edges, keys).withColumn("w", scaled).drop("_sum")


def cap_rows(edges: DataFrame, cap: float, keys: Sequence[str] = ("src",)) -> DataFrame:
    """Sources whose weights sum above `cap` are scaled down to it."""
    shrink = F.when(F.col("_sum") > 0, F.least(F.lit(1.0), F.lit(cap) / F.col("_sum"))).otherwise(1.0)
    return _with_sums(edges, keys).withColumn("w", F.col("w") * shrink).drop("_sum")


def scale_edge(edges: DataFrame, src: str, dst: str, factor: float) -> DataFrame:
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return edges.withColumn("w", F.when(hit, F.col("w") * factor).otherwise(F.col("w")))


def scale_row(edges: DataFrame, src: str, factor: float, cap: float | None = 0.2) -> DataFrame:
    """One source's weights times `factor`, then held to a sum of `cap` if given."""
    mine = (F.col("src") == src) & (F.col("src") != F.col("dst"))
    scaled = edges.withColumn("w", F.when(mine, F.col("w") * factor).otherwise(F.col("w")))
    if cap is None:
        return scaled
    # one row, as only one source is left
    total = F.broadcast(scaled.filter(mine).groupBy("src").agg(F.sum("w").alias("_sum")))
    over = mine & (F.col("_sum") > cap)
    shrunk = F.when(over, F.col("w") * (F.lit(cap) / F.col("_sum"))).otherwise(F.col("w"))
    return scaled.join(total, "src", "left").withColumn("w", shrunk).drop("_sum")


def one_hop(edges: DataFrame, src: str, dst: str, rate: float = K.ONE_HOP_RATE) -> DataFrame:
    """Every edge 0, except one at `rate`; none if both ends are the same."""
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    zeros = edges.select("src", "dst", F.lit(0.0).alias("w"))
    if src == dst:
        return zeros
    only = rows_to_df(edges.sparkSession, [(src, dst, rate)], "src STRING, dst STRING, w DOUBLE")
    return zeros.filter(~hit).unionByName(only)


def _reach(lat: Column, angle: float) -> Column:
    """The largest difference in longitude, in degrees, to a point at most `angle` (radians) away; null if a pole is."""
    share = F.lit(math.sin(angle)) / F.cos(F.radians(lat))
    return F.when(F.abs(lat) + F.lit(math.degrees(angle)) < 90.0, F.degrees(F.asin(F.least(share, F.lit(1.0)))))


def pairs_within(places: DataFrame, km: float, id: str = "id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(src, dst, km): the pairs of places, src < dst, at most `km` apart by great circles; no links are needed.

    Places lie in cells of a grid: bands of latitude as high as the distance, cut
    into cells of longitude as wide as it is at the band's far edge; a band that a
    pole is near is one cell. A place meets the cells of its own band and the next
    that its circle can touch, over the date line too, so pairs come from an
    equality join on cells, each once. Cells of many places are cut into parts that
    a place meets one by one, and the join has as many tasks as its pairs need.
    Places are compared by the chord between them, and its distance is worked out
    for a pair that is near enough.
    Places without an id or a position have no pairs. `km` is below a quarter of
    the way around the earth.
    """
    angle = km / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-9
    if not (km > 0 and angle < math.pi / 2):
        raise ValueError("the distance must be above 0 and below a quarter of the way around the earth")
    height = math.degrees(angle)
    bands = math.ceil(180.0 / height)
    x, y = F.pmod(F.col("lon") + 180.0, F.lit(360.0)), F.col("lat")
    band = F.least(F.floor((y + 90.0) / height), F.lit(bands - 1)).cast("int")

    def width(b: Column) -> Column:
        """How wide the cells of a band are, in degrees; they go around evenly."""
        far = F.greatest(F.abs(b * height - 90.0), F.abs((b + 1) * height - 90.0))
        return F.lit(360.0) / F.coalesce(F.greatest(F.floor(F.lit(360.0) / _reach(far, angle)), F.lit(1)), F.lit(1))

    own = places.select(F.col(id).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    own = own.filter("id IS NOT NULL AND abs(lat) <= 90 AND lon IS NOT NULL AND NOT isnan(lon)").withColumn("band", band)
    last = lambda w: F.round(F.lit(360.0) / w).cast("int") - 1
    cell = F.least(F.floor(x / width(F.col("band"))).cast("int"), last(width(F.col("band"))))
    north = F.radians("lat")
    ball = {"x": F.cos(north) * F.cos(F.radians("lon")), "y": F.cos(north) * F.sin(F.radians("lon")), "z": F.sin(north)}
    own = own.withColumn("cell", cell)
    sizes = stored(own.groupBy("band", "cell").agg(F.count("*").alias("n")), "cell-sizes")
    compared = 5 * (sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0)
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), compared // TASK_PAIRS)
    # at most one cell for each CELL_ROWS places
    full = F.broadcast(sizes.filter(F.col("n") > CELL_ROWS).withColumn("parts", F.ceil(F.col("n") / CELL_ROWS).cast("int")).drop("n"))
    parts, spots = F.coalesce("parts", F.lit(1)), ["id", "lat", "lon", *ball]
    key = ["band", "cell", "part"]
    index = own.withColumns(ball).join(full, ["band", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id", "lat", "lon"), parts).cast("int"))
    index = index.select(*key, *[F.col(c).alias(f"b_{c}") for c in spots]).repartition(tasks, *key)

    near = F.sequence("band", F.least(F.col("band") + 1, F.lit(bands - 1)))
    own = own.repartition("id").withColumns({**ball, "own_band": F.col("band"), "own_cell": F.col("cell")})
    asked = own.select(*spots, "own_band", "own_cell", F.explode(near).alias("band")).withColumn("w", width(F.col("band")))
    reach, n = _reach(F.col("lat"), angle), last(F.col("w")) + 1
    first, end = F.floor((x - reach) / F.col("w")).cast("int"), F.floor((x + reach) / F.col("w")).cast("int")
    part = F.transform(F.sequence(first, end), lambda c: F.pmod(c, n))
    whole = F.sequence(F.lit(0), n - 1)
    cells = F.when(reach.isNull() | (end - first + 1 >= n), whole).otherwise(part)
    same = (F.col("band") == F.col("own_band")) & (F.col("cell") == F.col("own_cell"))
    ahead = (F.col("band") > F.col("own_band")) | (F.col("cell") >= F.col("own_cell"))
    probes = asked.withColumn("cell", F.explode(cells)).filter(ahead).join(full, ["band", "cell"], "left")
    probes = probes.select("band", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), same.alias("same"), *spots)
    met = probes.repartition(tasks, *key).join(index.hint("merge"), key)
    chord = sum(((F.col(c) - F.col(f"b_{c}")) * (F.col(c) - F.col(f"b_{c}")) for c in ball), F.lit(0.0))
    apart = haversine_km(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))
    far = 2 * math.sin(angle / 2)
    # rounding could decide only for chords that differ from the longest one by little
    close = (chord <= F.lit(far * far)) & ((chord <= F.lit(max(0.0, far - 1e-7) ** 2)) | (apart <= km))
    once = (F.col("same") & (F.col("id") < F.col("b_id"))) | (~F.col("same") & (F.col("id") != F.col("b_id")))
    return met.filter(once & close).select(F.least("id", "b_id").alias("src"), F.greatest("id", "b_id").alias("dst"), apart.alias("km"))
