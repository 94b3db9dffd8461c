"""Context of anchors: names and tags into categories, nearest places by category, candidates against peers, and tiles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .joins import within_radius


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalized_name(name: Column) -> Column:
    """Compatibility-composed, trimmed, lower-case, white space as one space; null is empty. Names of plain ASCII never reach Python."""
    text = F.coalesce(name.cast("string"), F.lit(""))
    composed = F.when(text.rlike("^[\\x00-\\x7f]*$"), text).otherwise(_nfkc(text))
    return F.regexp_replace(F.trim(F.lower(composed)), "\\s+", " ")


def lexical_categories(normalized: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """The categories of which any token is in the name, in the rules' order."""
    has = lambda tokens: F.greatest(F.lit(False), *[F.contains(normalized, F.lit(t.lower())) for t in tokens])
    return F.array_compact(F.array(*[F.when(has(tokens), F.lit(c)) for c, tokens in rules.items()]))


def classified_names(pois: DataFrame, name: str, rules: dict[str, tuple[str, ...]], work: tuple[str, ...]) -> DataFrame:
    """pois with normalized, categories, signals, status (unknown, single_signal, ambiguous_multi_signal) and work_signal."""
    p = pois.withColumn("normalized", normalized_name(F.col(name))).withColumn("categories", lexical_categories(F.col("normalized"), rules))
    n = F.size("categories")
    status = F.when(n == 0, "unknown").when(n == 1, "single_signal").otherwise("ambiguous_multi_signal")
    return p.withColumns({"signals": n, "status": status, "work_signal": F.arrays_overlap("categories", F.array(*[F.lit(c) for c in work]))})


def tag_categories(tags: Column, rules: dict[str, dict[str, tuple[str, ...]]]) -> Column:
    """Categories of a map of tags. rules: category -> key -> values; ``*`` stands for any value but empty and no."""
    def meets(key: str, values: tuple[str, ...]) -> Column:
        v = F.lower(F.coalesce(F.element_at(tags, key), F.lit("")))
        return ~v.isin("", "no") if values == ("*",) else v.isin(*values)

    return F.array_sort(F.array_compact(F.array(*[F.when(F.greatest(F.lit(False), *[meets(k, v) for k, v in own.items()]), F.lit(c)) for c, own in rules.items()])))


def modal_code(values: DataFrame, by: list[str], code: str, nodata: int | None = None) -> DataFrame:
    """The most frequent positive code of each group; ties go to the least, and the missing code never counts."""
    from .relational import mode_by

    ok = (F.col(code) > 0) & (F.col(code) != nodata if nodata is not None else F.lit(True))
    return mode_by(values.where(ok), by, code)


def category_metrics(anchors: DataFrame, places: DataFrame, thresholds: tuple[float, ...], categories: tuple[str, ...], cell_deg: float = 0.01) -> DataFrame:
    """A row an anchor (id) and category: nearest place within the largest threshold, how many, whether within each threshold, and a bucket.

    places: id, lat, lon, category. Anchors without any place near keep a row for each category.
    """
    most = max(thresholds)
    near = within_radius(anchors, places, most, cell_deg).join(places.select(F.col("id").alias("place_id"), "category"), "place_id")
    g = near.groupBy("anchor_id", "category").agg(F.min("distance_m").alias("nearest_m"), F.count("*").alias("places"))
    grid = anchors.select(F.col("id").alias("anchor_id"), F.explode(F.array(*[F.lit(c) for c in categories])).alias("category"))
    m = grid.join(g, ["anchor_id", "category"], "left").fillna({"places": 0})
    bucket = F.lit("beyond")
    for t in sorted(thresholds, reverse=True):
        bucket = F.when(F.col("nearest_m") <= t, f"within_{t:g}").otherwise(bucket)
    return m.withColumns({**{f"within_{t:g}": F.coalesce(F.col("nearest_m") <= t, F.lit(False)) for t in thresholds}, "censored_m": F.least(F.coalesce("nearest_m", F.lit(most)), F.lit(most)), "bucket": bucket})


def threshold_shares(metrics: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Per category and threshold: anchors, those with a place within, and their share."""
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold_m"), F.col(f"within_{t:g}").alias("hit")) for t in thresholds])
    return metrics.select("category", F.inline(rows)).groupBy("category", "threshold_m").agg(F.count("*").alias("anchors"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.count("*")).alias("share"))


def against_peers(rows: DataFrame, group: str, candidate: str, value: str) -> DataFrame:
    """Per group with one candidate row (flag) or more: the candidates' mean, the peers' mean and number, the difference and its sign."""
    mean = lambda flag: F.avg(F.when(F.col(candidate) == flag, F.col(value)))
    g = rows.groupBy(group).agg(mean(True).alias("own"), mean(False).alias("peers"), F.count_if(~F.col(candidate)).alias("n_peers"))
    g = g.where("own is not null").withColumn("difference", F.col("own") - F.col("peers"))
    return g.withColumn("sign", F.when(F.col("difference") > 1e-12, "+").when(F.col("difference") < -1e-12, "-").when(F.col("difference").isNotNull(), "0"))


def padded_tiles(anchors: DataFrame, size_micro: int, padding_m: float) -> DataFrame:
    """Tiles that hold anchors, with their number and the bounds of these, padded by metres at their mean latitude."""
    from ..functions.geo import micro_cell

    g = anchors.groupBy(micro_cell(F.col("lat"), size_micro).alias("cy"), micro_cell(F.col("lon"), size_micro).alias("cx")).agg(
        F.count("*").alias("anchors"), F.avg("lat").alias("_lat"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n in ((F.min, "least"), (F.max, "most"))]
    )
    high, wide = F.lit(padding_m / 111_320.0), padding_m / (111_320.0 * F.greatest(F.cos(F.radians("_lat")), F.lit(1e-6)))
    return g.select("cy", "cx", "anchors", (F.col("least_lat") - high).alias("south"), (F.col("most_lat") + high).alias("north"), (F.col("least_lon") - wide).alias("west"), (F.col("most_lon") + wide).alias("east"))
