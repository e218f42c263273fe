"""Classes and ramps of the map and the result labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of the velocity colours in mm per year, lower bound included.
VELOCITY_STEPS = (-5, -2, -1, 1, 2, 5, 10)
# Slope ramp breakpoints in degrees.
SLOPE_STEPS = (0, 5, 15, 25, 35, 90)
BANDS = ("low", "medium", "high")
# Published velocity thresholds in mm per year.
VELOCITY_THRESHOLDS = {"strong_subsidence": -5.0, "moderate_subsidence": -2.0, "stable_min": -1.0, "stable_max": 1.0, "moderate_uplift": 2.0, "strong_uplift": 5.0}
# Colour ramps of the result maps; a missing agreement is grey.
QUALITY_RAMP = ((0, "#8e0f2f"), (0.4, "#d97b29"), (0.7, "#f2c14e"), (1, "#1b9e77"))
ANOMALY_RAMP = ((0, "#1b9e77"), (0.4, "#f2c14e"), (0.7, "#d97b29"), (1, "#8e0f2f"))
AGREEMENT_RAMP, NO_AGREEMENT = ((0, "#8e0f2f"), (0.5, "#f2c14e"), (1, "#1b9e77")), "#9aa0a6"
# Range and default of the height sensitivity in metres.
SENSITIVITY = (1.0, 100.0, 10.0)


def step_class(value: Column, steps: tuple[float, ...]) -> Column:
    """How many steps a value has reached; null stays null."""
    return sum((F.when(value >= s, 1).otherwise(0) for s in steps), F.when(value.isNotNull(), 0))


def velocity_class(velocity: Column) -> Column:
    return step_class(velocity, VELOCITY_STEPS)


def motion_class(motion: Column) -> Column:
    return step_class(F.coalesce(motion, F.lit(0.0)), VELOCITY_STEPS)


def velocity_tone(velocity: Column) -> Column:
    return F.when(F.abs(velocity) < 1, "good").when(F.abs(velocity) < 3, "warning").otherwise("bad")


def height_cycle(height: Column, span: float = 10.0, base: float = 450.0) -> Column:
    """One of nine bins that repeat every nine spans above the base; null stays null."""
    return F.floor(F.pmod(F.greatest(F.lit(0.0), height - base), F.lit(9 * span)) / span).cast("int")


def height_bucket(rank: Column) -> Column:
    return F.when(rank <= 0.33, "lower").when(rank <= 0.66, "middle").otherwise("upper")


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation, constant beyond the ends."""
    out = F.when(value <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        out = out.when(value <= x1, y0 + (value - x0) / (x1 - x0) * (y1 - y0))
    return out.when(value.isNotNull(), F.lit(float(stops[-1][1])))


def slope_ramp(slope: Column) -> Column:
    return ramp(slope, [(s, i / (len(SLOPE_STEPS) - 1)) for i, s in enumerate(SLOPE_STEPS)])


def color_ramp(value: Column, stops: tuple[tuple[float, str], ...]) -> Column:
    """Hex colour between the stops, each channel on its own."""
    channel = lambda i: F.round(ramp(value, [(x, int(c[i : i + 2], 16)) for x, c in stops])).cast("int")
    return F.format_string("#%02x%02x%02x", *[channel(i) for i in (1, 3, 5)])


def quality_color(quality: Column) -> Column:
    return color_ramp(F.coalesce(quality, F.lit(0.0)), QUALITY_RAMP)


def anomaly_color(anomaly: Column) -> Column:
    return color_ramp(F.coalesce(anomaly, F.lit(0.0)), ANOMALY_RAMP)


def agreement_color(agreement: Column) -> Column:
    return F.when(agreement.isNull(), NO_AGREEMENT).otherwise(color_ramp(agreement, AGREEMENT_RAMP))


def thresholds() -> Column:
    """The velocity thresholds as a struct."""
    return F.struct(*[F.lit(v).alias(k) for k, v in VELOCITY_THRESHOLDS.items()])


def height_sensitivity(value: Column) -> Column:
    """Held to its range, to a tenth below ten and whole above; a missing value is the default."""
    low, high, default = SENSITIVITY
    held = F.least(F.lit(high), F.greatest(F.lit(low), value))
    rounded = F.when(held < 10, F.floor(held * 10 + 0.5) / 10).otherwise(F.floor(held + 0.5).cast("double"))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(default)).otherwise(rounded)


def sensitivity_slider(value: Column) -> Column:
    """Place on a logarithmic slider from 0 to 2."""
    return F.log10(height_sensitivity(value))


def slider_sensitivity(place: Column) -> Column:
    return F.when(place.isNull() | F.isnan(place), F.lit(SENSITIVITY[2])).otherwise(height_sensitivity(F.pow(F.lit(10.0), F.least(F.lit(2.0), F.greatest(F.lit(0.0), place)))))


def dataset_sensor(dataset_id: Column) -> Column:
    """The sensor of a dataset, null if it is unknown; a missing dataset is the first one."""
    from subsidia.sources.tracks import DATASETS

    name, out = F.coalesce(dataset_id, F.lit(DATASETS[0][0])), F.lit(None).cast("string")
    for dataset, _, _, sensor, _ in DATASETS:
        out = F.when(name == dataset, sensor).otherwise(out)
    return out


def quality_label(quality: Column, normal: float = 0.70, outlier: float = 0.40) -> Column:
    return F.when(quality >= normal, "normal").when(quality < outlier, "outlier").otherwise("suspect")


def reliability_band(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def capped_band(band: Column, cap: Column) -> Column:
    """The lower of two bands; a null cap caps nothing."""
    order = F.array(*[F.lit(b) for b in BANDS])
    return F.when(band.isNull() | cap.isNull(), band).otherwise(F.element_at(order, F.least(F.array_position(order, band), F.array_position(order, cap)).cast("int")))


def stability_band(points: Column, support: Column, ci_width: Column) -> Column:
    """Stability of a track's cluster under resampling."""
    loose = F.when((ci_width <= 1.50) & (support >= 0.20), "monitor").otherwise("unstable")
    return F.when((points < 2) | ci_width.isNull(), "unstable").when((ci_width <= 0.75) & (support >= 0.35), "stable").otherwise(loose)


def building_stability_band(bands: Column, building_width: Column, agreement_width: Column) -> Column:
    """Stability of a building from its tracks' bands (an array)."""
    unlike = lambda x: F.exists(bands, lambda b: b != x)
    narrow = (building_width <= 1.00) & (agreement_width.isNull() | (agreement_width <= 0.35))
    several = F.when(~unlike("stable"), F.when(narrow, "stable").otherwise("monitor")).when(~unlike("unstable"), "unstable").otherwise("monitor")
    return F.when(F.size(bands) == 0, "unstable").when(F.size(bands) > 1, several).when(F.get(bands, F.lit(0)) != "unstable", "monitor").otherwise("unstable")


def palette_index(key: Column, size: int = 60) -> Column:
    """Colour of a key: the first 8 hex digits of its SHA-1, modulo the palette."""
    return (F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long") % size).cast("int")
