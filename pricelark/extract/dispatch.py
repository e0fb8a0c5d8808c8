"""Snapshots of pages of any site, each by the extractor that the site brings."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelark.extract.layouts import extract_a, extract_b
from pricelark.functions.urls import Registry, default_sites, recognise

_NEEDS = {
    "expanded_offers": "array<struct<label:string,description:string>>",
    "local_stock": "string",
    "local_price_paise": "bigint",
    "local_mrp_paise": "bigint",
}


def site_registry() -> Registry:
    """The sites that are known from the start, with their extractors."""
    extractors = {"amazon_in": extract_a, "flipkart": extract_b}
    return Registry(*[replace(s, extract=extractors[s.name]) for s in default_sites()])


def snapshots(pages: DataFrame, registry: Registry) -> DataFrame:
    """``pages(url, html, ...)`` -> snapshot columns of every page of a registered site.

    The URL decides; pages of other sites are left out. Columns that only some extractors
    know, fetched besides the page, are null where the pages do not bring them.
    """
    missing = {c: F.lit(None).cast(kind) for c, kind in _NEEDS.items() if c not in pages.columns}
    known = pages.withColumns({**missing, "_site": recognise(F.col("url"), registry)["marketplace"]})
    found = [
        site.extract(known.filter(F.col("_site") == site.name).drop("_site"))
        for site in registry.sites
        if site.extract
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
