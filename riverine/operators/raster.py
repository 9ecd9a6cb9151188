"""Block aggregates, masks and runs of rasters (r, c and values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverine.functions.geo import tile_lat, tile_lon


def _blocks(cells: DataFrame, k: int) -> DataFrame:
    """cells with br, bc; those of cut-off blocks at the far edges are left out."""
    size = cells.agg(F.floor((F.max("r") + 1) / k).alias("__h"), F.floor((F.max("c") + 1) / k).alias("__w"))
    placed = cells.withColumn("br", F.floor(F.col("r") / k)).withColumn("bc", F.floor(F.col("c") / k))
    return placed.crossJoin(F.broadcast(size)).where("br < __h AND bc < __w").drop("__h", "__w")


def pooled(cells: DataFrame, k: int, value: str) -> DataFrame:
    """br, bc and the mean of each whole k x k block."""
    return _blocks(cells, k).groupBy("br", "bc").agg(F.avg(value).alias(value))


def overview(cells: DataFrame, k: int = 4) -> DataFrame:
    """br, bc, elev (mean without missing, 0 if all are), sea (more than half), height_cm (largest of 0 to 25000, 0 at sea)."""
    got = _blocks(cells, k).groupBy("br", "bc").agg(F.coalesce(F.avg("elev"), F.lit(0.0)).alias("elev"), (F.avg(F.col("sea").cast("double")) > 0.5).alias("sea"), F.max("height_cm").alias("__h"))
    return got.withColumn("height_cm", F.when(F.col("sea"), F.lit(0)).otherwise(F.least(F.greatest("__h", F.lit(0)), F.lit(25000))).cast("bigint")).drop("__h")


def region_grid(cells: DataFrame, k: int = 2, wall: float = 0.75) -> DataFrame:
    """br, bc, elev, wall (coverage of at least `wall`), mean_cm over covered pixels. A missing elevation counts as 0."""
    covered = F.count_if(F.col("height_cm") > 0)
    return _blocks(cells, k).groupBy("br", "bc").agg(
        F.avg(F.coalesce("elev", F.lit(0.0))).alias("elev"), (covered / F.count(F.lit(1)) >= wall).alias("wall"),
        F.coalesce(F.try_divide(F.sum("height_cm"), covered), F.lit(0.0)).alias("mean_cm"),
    )


def coastal(cells: DataFrame, margin: int = 1, below: float = 5.0) -> DataFrame:
    """cells with coastal: within margin of the border and lower than `below`; a grid of up to 2 margins is all border."""
    size = F.broadcast(cells.agg((F.max("r") + 1).alias("__h"), (F.max("c") + 1).alias("__w")))
    edge = F.expr(f"r < {margin} OR r >= __h - {margin} OR c < {margin} OR c >= __w - {margin} OR __h <= {2 * margin} OR __w <= {2 * margin}")
    return cells.crossJoin(size).withColumn("coastal", F.coalesce(edge & (F.col("elev") < below), F.lit(False))).drop("__h", "__w")


def coverage(cells: DataFrame, cell_m2: float) -> DataFrame:
    """One row: land area (above 0.5 m), built-up area, share of voids and their number."""
    return cells.agg(
        (F.count_if(F.col("elev") > 0.5) * cell_m2 / 1e6).alias("land_km2"), (F.count_if(F.col("height_cm") > 0) * cell_m2 / 1e6).alias("built_km2"),
        (F.count_if(F.col("elev").isNull()) / F.count(F.lit(1))).alias("void_share"), F.count_if(F.col("elev").isNull()).alias("voids"),
    )


def status_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def crop(cells: DataFrame, boxes: DataFrame, tile: int = 256) -> DataFrame:
    """box, r, c (from the box's corner) and values of the cells in each box (box, left, top, right, bottom; far sides excluded).

    Cells carry tile_r and tile_c, so a box is first joined on the tiles that it touches.
    """
    tiles = boxes.select("*", F.explode(F.sequence(F.floor(F.col("top") / tile), F.floor((F.col("bottom") - 1) / tile))).alias("tile_r"))
    tiles = tiles.select("*", F.explode(F.sequence(F.floor(F.col("left") / tile), F.floor((F.col("right") - 1) / tile))).alias("tile_c"))
    hit = tiles.join(cells, ["tile_r", "tile_c"]).where("r >= top AND r < bottom AND c >= left AND c < right")
    rest = [x for x in cells.columns if x not in ("r", "c", "tile_r", "tile_c")]
    return hit.select("box", (F.col("r") - F.col("top")).alias("r"), (F.col("c") - F.col("left")).alias("c"), *rest)


def rectangles(cells: DataFrame, least: int = 2) -> DataFrame:
    """r, c, w, h, height_cm, area: equal heights merged down the columns, then equal runs merged across; least x least at least."""
    down = Window.partitionBy("c", "height_cm").orderBy("r")
    runs = cells.where("height_cm > 0").withColumn("__g", F.col("r") - F.row_number().over(down)).groupBy("c", "height_cm", "__g").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("h"))
    across = Window.partitionBy("r", "h", "height_cm").orderBy("c")
    merged = runs.withColumn("__k", F.col("c") - F.row_number().over(across)).groupBy("r", "h", "height_cm", "__k").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("w"))
    return merged.where((F.col("w") >= least) & (F.col("h") >= least)).select("r", "c", "w", "h", "height_cm", (F.col("w") * F.col("h")).alias("area"))


def largest(rects: DataFrame, k: int) -> DataFrame:
    return rects.orderBy(F.desc("area"), "r", "c").limit(k)


def box_ground(rects: DataFrame, cells: DataFrame) -> DataFrame:
    """r, c, base_m, top_m: the lowest of the ground at the box's corners and centre less 0.6, and its mean plus the height."""
    size = F.broadcast(cells.agg(F.max("r").alias("__r"), F.max("c").alias("__c")))
    half_up = lambda x: F.floor(x + 0.5)
    far_r, far_c = F.least(F.col("r") + F.col("h"), F.col("__r")), F.least(F.col("c") + F.col("w"), F.col("__c"))
    middle = (F.least(half_up(F.col("r") + F.col("h") / 2), F.col("__r")), F.least(half_up(F.col("c") + F.col("w") / 2), F.col("__c")))
    points = [(F.col("r"), F.col("c")), (F.col("r"), far_c), (far_r, F.col("c")), (far_r, far_c), middle]
    spots = rects.crossJoin(size).select("r", "c", "height_cm", F.explode(F.array(*[F.struct(a.cast("bigint").alias("y"), b.cast("bigint").alias("x")) for a, b in points])).alias("p"))
    ground = cells.select(F.col("r").alias("__y"), F.col("c").alias("__x"), F.col("elev"))
    found = spots.join(ground, (F.col("p.y") == F.col("__y")) & (F.col("p.x") == F.col("__x")), "left").withColumn("elev", F.coalesce("elev", F.lit(0.0)))
    return found.groupBy("r", "c", "height_cm").agg((F.min("elev") - 0.6).alias("base_m"), (F.avg("elev") + F.first("height_cm") / 100.0).alias("top_m")).drop("height_cm")


def clipped(elev: Column, low: float = -3.0, high: float = 3000.0) -> Column:
    return F.least(F.greatest(elev, F.lit(low)), F.lit(high))


def dataset_row(cells: DataFrame, tile: int, cell_area_m2: float, tile_x0: int, tile_y0: int) -> DataFrame:
    """One row on a raster (r, c, elev, height_cm) whose first cell begins tile tile_x0, tile_y0: tile range, size, land area, whether
    there are buildings, the degrees that its tiles span, and how tiles are coded."""
    number = lambda k: F.floor(F.col(k) / tile)
    row = cells.agg(
        F.min(number("r")).alias("y0"), F.max(number("r")).alias("y1"), F.min(number("c")).alias("x0"), F.max(number("c")).alias("x1"), (F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height"),
        (F.count_if(F.col("elev") > 0.5) * cell_area_m2 / 1e6).alias("land_km2"), (F.count_if(F.col("height_cm") > 0) > 0).alias("buildings"),
    )
    return row.select(
        "*", tile_lon(tile_x0 + F.col("x0")).alias("lon_min"), tile_lat(tile_y0 + F.col("y1") + 1).alias("lat_min"), tile_lon(tile_x0 + F.col("x1") + 1).alias("lon_max"),
        tile_lat(tile_y0 + F.col("y0")).alias("lat_max"), F.lit("r*65536+g*256+b").alias("elevation_encoding"), F.lit("r*256+g").alias("building_encoding"),
    )
