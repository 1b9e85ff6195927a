"""Package ecosystems, platform names (CPE) and what decides the route of a search."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes and names of ecosystem classes, and ecosystems of platform vendors.
DPKG_PREFIXES = ("Ubuntu:", "Debian:", "Alpine:")
DISTRO_PREFIXES = ("AlmaLinux:", "Rocky:", "CentOS:", "Red Hat:", "Oracle Linux:", *DPKG_PREFIXES)
LANGUAGES = ("npm", "PyPI", "Maven", "Go", "NuGet", "RubyGems", "crates.io", "Packagist")
VENDOR_ECOSYSTEMS = {
    "python": "PyPI", "pypi": "PyPI", "nodejs": "npm", "npm": "npm", "node": "npm", "redhat": "Red Hat", "almalinux": "AlmaLinux", "centos": "CentOS",
    "rockylinux": "Rocky", "debian": "Debian", "ubuntu": "Ubuntu", "suse": "openSUSE", "opensuse": "openSUSE", "rubygems": "RubyGems", "ruby": "RubyGems",
    "packagist": "Packagist", "php": "Packagist", "maven": "Maven", "apache": "Maven", "golang": "Go", "google": "Go", "nuget": "NuGet", "microsoft": "NuGet",
    "crates": "crates.io", "rust": "crates.io",
}


def _starts(c: Column, prefixes) -> Column:
    return F.coalesce(F.greatest(*(c.startswith(p) for p in prefixes)), F.lit(False))


def is_distro(eco: Column) -> Column:
    return _starts(eco, DISTRO_PREFIXES) | F.coalesce(eco == "oracle-linux", F.lit(False))


def is_dpkg_style(eco: Column) -> Column:
    return _starts(eco, DPKG_PREFIXES)


def is_language(eco: Column) -> Column:
    return F.coalesce(eco.isin(*LANGUAGES), F.lit(False))


def normalize_ecosystem(eco: Column) -> Column:
    return F.when(F.lower(eco) == "composer", "Packagist").otherwise(eco)


def rpm_vendor(eco: Column) -> Column:
    """Advisory source with rpm versions for an ecosystem, or null."""
    return F.when(eco.startswith("Red Hat:"), "red-hat").when((eco == "oracle-linux") | eco.startswith("Oracle Linux:"), "oracle-linux")


def base_ecosystem(eco: Column) -> Column:
    return F.split_part(eco, F.lit(":"), F.lit(1))


def vendor_ecosystem(vendor: Column) -> Column:
    return F.create_map(*map(F.lit, chain(*VENDOR_ECOSYSTEMS.items())))[F.lower(vendor)]


def route(eco: Column) -> Column:
    """Which comparison a search in an ecosystem takes."""
    eco = normalize_ecosystem(eco)
    return (
        F.when(eco.isNull(), "default").when(is_language(eco), "language").when(is_dpkg_style(eco), "dpkg")
        .when(rpm_vendor(eco).isNotNull(), "rpm").when(is_distro(eco), "list").otherwise("other")
    )


def parse_listed_cpe(cpe: Column) -> Column:
    """As ``parse_cpe`` for the names of a feed: applications and systems alone, and '-' is a name like any other."""
    f = F.split(cpe, ":")
    named = lambda c: ~F.coalesce(c, F.lit("")).isin("", "*")
    version = F.get(f, 5)
    return F.when(
        cpe.startswith("cpe:2.3:") & F.get(f, 2).isin("a", "o") & named(F.get(f, 3)) & named(F.get(f, 4)),
        F.struct(F.get(f, 2).alias("part"), F.get(f, 3).alias("vendor"), F.get(f, 4).alias("product"), F.when(named(version) & (version != "-"), version).alias("version")),
    )


def parse_cpe(cpe: Column) -> Column:
    """(part, vendor, product, version) of a CPE 2.3 name; null if it has too few fields or no vendor or product."""
    f = F.split(cpe, ":")
    named = lambda c: ~F.coalesce(c, F.lit("")).isin("", "*", "-")
    version = F.get(f, 5)
    return F.when(
        cpe.startswith("cpe:2.3:") & (F.size(f) >= 5) & named(F.get(f, 3)) & named(F.get(f, 4)),
        F.struct(F.get(f, 2).alias("part"), F.get(f, 3).alias("vendor"), F.get(f, 4).alias("product"), F.when(named(version), version).alias("version")),
    )
