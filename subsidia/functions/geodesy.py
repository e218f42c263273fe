"""Distances on the WGS84 spheroid as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from subsidia.functions.geo import FLATTENING, SEMI_MAJOR, let, rings_distance

SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
_SQUARED = FLATTENING * (2 - FLATTENING)
#: Steps of the geodesic's iteration; places that are not nearly opposite need fewer.
STEPS = 12


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Length of a degree of longitude and of latitude at a latitude."""
    w = 1 - _SQUARED * F.sin(F.radians(lat)) ** 2
    return F.radians(F.lit(1.0)) * SEMI_MAJOR * F.cos(F.radians(lat)) / F.sqrt(w), F.radians(F.lit(1.0)) * SEMI_MAJOR * (1 - _SQUARED) / (w * F.sqrt(w))


def geodesic_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = STEPS) -> Column:
    """Metres between two places along the spheroid, by the inverse series of Vincenty.

    The longitude on the auxiliary sphere is found in a fixed number of steps.
    Nearly opposite places, for which it does not settle, give null, as does
    anything null.
    """
    f = FLATTENING
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    zero = lambda c: F.when(c == 0, F.lit(1.0)).otherwise(c)

    def measured(at: Column) -> Column:
        def sphere(lam: Column) -> Column:
            """What an auxiliary longitude gives: arc, azimuth and middle of the line."""

            def arcs(s: Column) -> Column:
                sigma = F.atan2(s["sin"], s["cos"])
                alpha = at["cc"] * F.sin(lam) / zero(s["sin"])
                square = 1 - alpha * alpha
                middle = F.when(square > 1e-15, s["cos"] - 2 * at["ss"] / zero(square)).otherwise(F.lit(0.0))
                return F.struct(sigma.alias("sigma"), s["sin"].alias("sin"), s["cos"].alias("cos"), alpha.alias("alpha"), square.alias("square"), middle.alias("middle"))

            across, along = at["c2"] * F.sin(lam), at["c1"] * at["s2"] - at["s1"] * at["c2"] * F.cos(lam)
            return let(F.struct(F.sqrt(across * across + along * along).alias("sin"), (at["ss"] + at["cc"] * F.cos(lam)).alias("cos")), arcs)

        def step(lam: Column) -> Column:
            def next_one(v: Column) -> Column:
                c = f / 16 * v["square"] * (4 + f * (4 - 3 * v["square"]))
                return at["lon"] + (1 - c) * f * v["alpha"] * (v["sigma"] + c * v["sin"] * (v["middle"] + c * v["cos"] * (2 * v["middle"] * v["middle"] - 1)))

            return let(sphere(lam), next_one)

        start = F.struct(at["lon"].alias("now"), at["lon"].alias("before"))
        settled = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(step(s["now"]).alias("now"), s["now"].alias("before")))

        def length(s: Column) -> Column:
            def of(v: Column) -> Column:
                u = v["square"] * (SEMI_MAJOR**2 / SEMI_MINOR**2 - 1)
                a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
                b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
                m2 = v["middle"] * v["middle"]
                change = b * v["sin"] * (v["middle"] + b / 4 * (v["cos"] * (2 * m2 - 1) - b / 6 * v["middle"] * (4 * v["sin"] * v["sin"] - 3) * (4 * m2 - 3)))
                return SEMI_MINOR * a * (v["sigma"] - change)

            return F.when(F.abs(s["now"] - s["before"]) < 1e-10, let(sphere(s["now"]), of))

        return let(settled, length)

    def prepared(u: Column) -> Column:
        s1, c1, s2, c2 = F.sin(u["a"]), F.cos(u["a"]), F.sin(u["b"]), F.cos(u["b"])
        return let(F.struct(s1.alias("s1"), c1.alias("c1"), s2.alias("s2"), c2.alias("c2"), (s1 * s2).alias("ss"), (c1 * c2).alias("cc"), u["lon"].alias("lon")), measured)

    turn = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    return let(F.struct(reduced(lat1).alias("a"), reduced(lat2).alias("b"), turn.alias("lon")), prepared)


def geography_distance(lon: Column, lat: Column, rings: Column) -> Column:
    """Metres from a place to a polygon in degrees, 0 where it covers the place.

    Degrees are measured by the spheroid's radii at the place, so the error
    grows with the square of the distance: below a millimetre within 100 m.
    """
    x, y = metres_per_degree(lat)
    return let(F.struct(x.alias("x"), y.alias("y")), lambda k: rings_distance(lon, lat, rings, (k["x"], k["y"])))
