"""Listing URLs: recognition, canonical form and marketplace product id."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelark.functions.binding import let
from pricelark.model import MARKETPLACE_LABELS

# Domains each marketplace claims, and its id shapes.
DOMAINS = {
    "amazon_in": ["amazon.in", "amzn.in"],
    "flipkart": ["flipkart.com", "dl.flipkart.com"],
}
ASIN_PATHS = [
    r"/dp/([A-Z0-9]{10})(?:/|$)",
    r"/gp/product/([A-Z0-9]{10})(?:/|$)",
    r"/gp/aw/d/([A-Z0-9]{10})(?:/|$)",
    r"/product/([A-Z0-9]{10})(?:/|$)",
]
ASIN = r"^[A-Z0-9]{10}$"
ITEM_PATH = r"/p/(itm[0-9a-zA-Z]{13})(?:/|$)"
VARIANT = r"^[A-Z0-9]{16}$"

# absolute URL: scheme, optional credentials, host, optional port, then path, query, fragment
_SHAPE = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):/*(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::\d*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@dataclass(frozen=True)
class Site:
    """A marketplace: its domains, what a listing's path and query say, and how its pages are read.

    ``listing(path, query)`` gives struct<id, url>, the id and canonical form of a listing, null for
    other pages. ``extract(pages)`` gives snapshot columns of pages (url, html, ...).
    """

    name: str
    label: str
    domains: tuple[str, ...]
    listing: Callable[[Column, Column], Column]
    extract: Callable[[DataFrame], DataFrame] | None = None


class Registry:
    """Sites by domain; a domain can be claimed once. Nothing else names a site."""

    def __init__(self, *sites: Site) -> None:
        self.sites: list[Site] = []
        self.domains: dict[str, str] = {}
        for site in sites:
            self.register(site)

    def claim(self, marketplace: str, domains: Iterable[str]) -> None:
        for domain in map(str.lower, domains):
            if domain in self.domains:
                raise ValueError(f"domain {domain} is already claimed by {self.domains[domain]}")
            self.domains[domain] = marketplace

    def register(self, site: Site) -> None:
        self.claim(site.name, site.domains)
        self.sites.append(site)

    def marketplace_of(self, host: Column) -> Column:
        """The marketplace that claims the host or the nearest parent of it."""
        longest = sorted(self.domains, key=len, reverse=True)
        pattern = r"(?:^|\.)(" + "|".join(re.escape(d) for d in longest) + ")$"
        names = F.create_map(*[F.lit(x) for pair in self.domains.items() for x in pair])
        return F.try_element_at(names, F.regexp_extract(host, pattern, 1))

    def listing(self, marketplace: Column, path: Column, query: Column) -> Column:
        """struct<id, url> by the site's own rule; the other sites' shapes are not searched."""
        out = None
        for site in self.sites:
            test, found = marketplace == site.name, site.listing(path, query)
            out = F.when(test, found) if out is None else out.when(test, found)
        return out

    def supported(self) -> str:
        """Labels of the sites, as a sentence names them."""
        *most, last = [s.label for s in self.sites]
        return f"{', '.join(most)} and {last} are" if most else f"{last} is"


def found_listing(found: Column, id_: Column, url: Column) -> Column:
    return F.when(found.isNotNull(), F.struct(id_.alias("id"), url.alias("url")))


def _listing_a(path: Column, query: Column) -> Column:
    asin = F.coalesce(*[_group(path, p) for p in ASIN_PATHS], _param(query, "asin", ASIN))
    return let(asin, lambda x: found_listing(x, x, F.concat(F.lit("https://www.amazon.in/dp/"), x)))


def _listing_b(path: Column, query: Column) -> Column:
    parts = F.struct(_group(path, ITEM_PATH).alias("item"), _param(query, "pid", VARIANT).alias("variant"))

    def form(x: Column) -> Column:
        extra = F.coalesce(F.concat(F.lit("?pid="), x["variant"]), F.lit(""))
        url = F.concat(F.lit("https://www.flipkart.com/product/p/"), x["item"], extra)
        return found_listing(x["item"], F.coalesce(x["variant"], x["item"]), url)

    return let(parts, form)


def default_sites() -> list[Site]:
    rules = {"amazon_in": _listing_a, "flipkart": _listing_b}
    return [Site(name, MARKETPLACE_LABELS[name], tuple(DOMAINS[name]), rule) for name, rule in rules.items()]


def default_registry() -> Registry:
    return Registry(*default_sites())


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match; the text is searched once."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def _param(query: Column, name: str, shape: str) -> Column:
    """The first value of a query parameter, when it has the shape."""
    value = r"(?:^|&)" + name + "=([^&]*)"
    return _group(_group(query, value), "(" + shape + ")")


def recognise(url: Column, registry: Registry | None = None) -> Column:
    """struct<kind, marketplace, canonical_url, marketplace_product_id, detected_site>.

    Never fails: malformed text is an unsupported URL without a site.
    """
    registry = registry or default_registry()
    parts = F.struct(
        F.regexp_replace(F.lower(_group(url, _SHAPE, 2)), r"^www\.", "").alias("host"),
        _group(url, _SHAPE, 3).alias("path"),
        _group(url, _SHAPE, 4).alias("query"),
    )

    def form(x: Column) -> Column:
        found, known = x["listing"], x["marketplace"].isNotNull()
        return F.struct(
            F.when(~known, "unsupported").when(found.isNull(), "not_a_listing").otherwise("listing").alias("kind"),
            x["marketplace"].alias("marketplace"),
            found["url"].alias("canonical_url"),
            found["id"].alias("marketplace_product_id"),
            F.when(~known, x["host"]).alias("detected_site"),
        )

    def looked_up(u: Column) -> Column:
        listing = registry.listing(u["marketplace"], u["path"], u["query"])
        return F.struct(u["host"].alias("host"), u["marketplace"].alias("marketplace"), listing.alias("listing"))

    def site(u: Column) -> Column:
        return F.struct(
            u["host"].alias("host"),
            registry.marketplace_of(u["host"]).alias("marketplace"),
            u["path"].alias("path"),
            u["query"].alias("query"),
        )

    return let(parts, lambda u: let(site(u), lambda v: let(looked_up(v), form)))
