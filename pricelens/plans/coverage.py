"""Catalog coverage audit and selector options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelens.functions.text import normalize_key, strip
from pricelens.operators.filters import ListingFilters, apply_filters

SERIES_LOW = 7
MODEL_LOW = 2


def coverage_counts(listings: DataFrame) -> DataFrame:
    """(level, bk, sk, mk, n): listings per folded brand, series and model; a blank key stops at its level.

    Exact names are counted first, so only distinct triples are folded.
    """
    triples = listings.groupBy("brand", "series", "model").agg(F.count("*").alias("n"))
    keyed = triples.select(*[normalize_key(F.col(c)).alias(k) for c, k in (("brand", "bk"), ("series", "sk"), ("model", "mk"))], "n")
    keyed = keyed.where(F.col("bk") != "")
    none = F.lit("")
    levels = F.array(
        F.struct(F.lit("brand").alias("level"), none.alias("s"), none.alias("m")),
        F.struct(F.lit("series").alias("level"), F.col("sk").alias("s"), none.alias("m")),
        F.struct(F.lit("model").alias("level"), F.col("sk").alias("s"), F.col("mk").alias("m")),
    )
    rows = keyed.select("bk", "n", "sk", "mk", F.explode(levels).alias("x")).where(
        (F.col("x.level") == "brand") | ((F.col("sk") != "") & ((F.col("x.level") == "series") | (F.col("mk") != "")))
    )
    return rows.groupBy(F.col("x.level").alias("level"), "bk", F.col("x.s").alias("sk"), F.col("x.m").alias("mk")).agg(F.sum("n").alias("n"))


def coverage_status(count: Column, threshold: int) -> Column:
    return F.when(count == 0, "missing").when(count <= threshold, "low").otherwise("covered")


def coverage(listings: DataFrame, entries: DataFrame, series_low: int = SERIES_LOW, model_low: int = MODEL_LOW) -> DataFrame:
    """(level, brand, series, model, listing_count, status) for every canonical catalog entry."""
    if series_low < 0 or model_low < 0:
        raise ValueError("coverage thresholds must not be negative")
    none = F.lit(None).cast("string")
    brands = entries.select("brand").distinct().select(F.lit("brand").alias("level"), "brand", none.alias("series"), none.alias("model"))
    series = entries.select("brand", "series").distinct().select(F.lit("series").alias("level"), "brand", "series", none.alias("model"))
    models = entries.where(F.col("model").isNotNull()).select(F.lit("model").alias("level"), "brand", "series", "model")
    wanted = brands.unionByName(series).unionByName(models)
    keyed = wanted.withColumns({k: normalize_key(F.col(c)) for c, k in (("brand", "bk"), ("series", "sk"), ("model", "mk"))})
    joined = keyed.join(coverage_counts(listings), ["level", "bk", "sk", "mk"], "left").fillna(0, ["n"])
    threshold = {"brand": series_low, "series": series_low, "model": model_low}
    status = F.coalesce(*[F.when(F.col("level") == level, coverage_status(F.col("n"), low)) for level, low in threshold.items()])
    return joined.select("level", "brand", "series", "model", F.col("n").alias("listing_count"), status.alias("status"))


def coverage_totals(report: DataFrame) -> DataFrame:
    return report.groupBy("level", "status").agg(F.count("*").alias("entries"))


def write_coverage(report: DataFrame, folder: str) -> None:
    """Three CSV reports with header; each run replaces the previous one."""
    shapes = {"brand": ["brand"], "series": ["brand", "series"], "model": ["brand", "series", "model"]}
    for level, columns in shapes.items():
        rows = report.where(F.col("level") == level).orderBy(*columns)
        named = rows.select(*columns, "listing_count", "status").withColumnRenamed("model", "package")
        name = "package" if level == "model" else level
        named.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}_coverage")


def selector_options(listings: DataFrame, entries: DataFrame, level: str = "brand", brand: str | None = None, series: str | None = None) -> DataFrame:
    """Catalog and listing names of one level, with the number of listings of exactly that name."""
    catalog = entries
    if brand is not None:
        catalog = catalog.where(F.lower("brand") == brand.lower())
    if series is not None:
        catalog = catalog.where(F.lower("series") == series.lower())
    rows = apply_filters(listings, ListingFilters(brand=brand, series=series)).where(F.col(level).isNotNull())
    counted = rows.groupBy(F.col(level).alias("exact")).agg(F.count("*").alias("listing_count"))
    names = catalog.select(strip(F.col(level)).alias("name")).unionByName(counted.select(strip(F.col("exact")).alias("name")))
    names = names.where(F.col("name") != "").distinct()
    joined = names.join(counted, F.col("name") == F.col("exact"), "left")
    return joined.select("name", F.coalesce("listing_count", F.lit(0)).alias("listing_count")).orderBy("name")


def audit_source(clean: DataFrame | None, raw: DataFrame, clean_again) -> DataFrame:
    """Clean listings when there are any; otherwise raw rows cleaned on the fly by ``clean_again``."""
    if clean is not None and not clean.limit(1).isEmpty():
        return clean
    return clean_again(raw)
