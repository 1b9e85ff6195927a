"""Vendors' pages and product lists: markup, table cells, headings and the ways versions are written there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .advisories import spoken_range
from .versions import bump_last_component

# The severities a vendor's word may name as it is.
KNOWN_SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
# Entities that pages use, in the order in which they are decoded.
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#8220;": '"', "&#8221;": '"', "&ldquo;": '"', "&rdquo;": '"'}


def _text(c) -> Column:
    return F.lit(None).cast("string") if c is None else c


def bounds(start=None, end=None, last=None, exact=None) -> Column:
    """(start, end, last, exact): inclusive start, exclusive end, inclusive last, a single version."""
    return F.struct(*(_text(c).alias(n) for c, n in ((start, "start"), (end, "end"), (last, "last"), (exact, "exact"))))


def plain_dashes(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[‒–—−]", "-"))


def next_minor(branch: Column, patch: bool = False) -> Column:
    """'11.1' as '11.2', or as '11.2.0'; null without a second number."""
    minor = F.regexp_extract(branch, r"^[^.]*\.(\d+)", 1)
    moved = F.concat(F.split_part(branch, F.lit("."), F.lit(1)), F.lit("."), (minor.try_cast("bigint") + 1).cast("string"), F.lit(".0" if patch else ""))
    return F.when(minor != "", moved)


def affects_entry(raw: Column) -> Column:
    """One entry of a list of affected versions: a dashed range, a branch ('4.4.*') as its end, or one version."""
    text, form = plain_dashes(raw), r"^([\w.]+)\s*-\s*([\w.*]+)\z"
    start, end = F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2)
    branch = next_minor(F.regexp_replace(end, r"\.\*\z", ""), patch=True)
    return (
        F.when(text.rlike(form) & end.contains("*"), bounds(start, branch))
        .when(text.rlike(form), bounds(start, None, end))
        .when(text.rlike(r"^\d[\w.]*\z"), bounds(None, None, None, text))
    )


def longest_name(ident: Column, names: Column) -> Column:
    """The longest of the names that the identifier starts with; of equal lengths the first."""
    fits = F.filter(names, lambda n: ident.startswith(n))
    return F.aggregate(fits, F.lit(None).cast("string"), lambda best, n: F.when(best.isNull() | (F.length(n) > F.length(best)), n).otherwise(best))


def named_versions(ident: Column, name: Column) -> Column:
    """What an identifier says behind its product's name: '-X', '>=a|<=b', 'X.Y all versions' or a version; null if nothing."""
    rest = F.substring(ident, F.length(name) + 1, F.length(ident))
    spec = F.trim(F.regexp_replace(rest, r"^[\s/]+", ""))
    both, every = r"^>=?(\d[\d.]+[^\s|]*)\|<=?(\d[\d.]+\S*)\z", r"(?i)^(\d+)\.(\d+)\s+all\s+versions\z"
    branch = F.concat(F.regexp_extract(spec, every, 1).try_cast("bigint").cast("string"), F.lit("."), F.regexp_extract(spec, every, 2).try_cast("bigint").cast("string"))
    return (
        F.when(rest.startswith("-"), bounds(None, None, None, F.substring(rest, 2, F.length(rest))))
        .when(spec.rlike(both), bounds(F.regexp_extract(spec, both, 1), None, F.regexp_extract(spec, both, 2)))
        .when(spec.rlike(every), bounds(F.concat(branch, F.lit(".0")), next_minor(branch, patch=True)))
        .when(spec != "", bounds(None, None, None, spec))
    )


def fixed_in_branch(start: Column, fixed: Column) -> Column:
    """The least text among fixed versions of the start's branch (its first two numbers)."""
    branch = F.concat(F.substring_index(start, ".", 2), F.lit("."))
    return F.array_min(F.filter(fixed, lambda v: v.startswith(branch)))


def trailing_comparison(name: Column) -> Column:
    """(op, version) of a comparison at the end of a name."""
    form = r"([<>]=?)(\d[\d.]*)\z"
    return F.when(name.rlike(form), F.struct(F.regexp_extract(name, form, 1).alias("op"), F.regexp_extract(name, form, 2).alias("version")))


def comparison(text: Column) -> Column:
    """(end, last, fixed) of '< x', '<= x' or '>= x'."""
    form = r"^\s*(<=|>=|<)\s*(\S+)\s*\z"
    op, v = F.regexp_extract(text, form, 1), F.nullif(F.regexp_extract(text, form, 2), F.lit(""))
    strict = (op == "<") & ~v.startswith("=")
    return F.struct(F.when(strict, v).alias("end"), F.when(op == "<=", v).alias("last"), F.when(op == ">=", v).alias("fixed"))


def not_vulnerable(text: Column) -> Column:
    """Fixed versions of a list like '1.31.3+, 1.30.4+'."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.regexp_replace(F.trim(v), r"\+\z", "")), lambda v: v.rlike(r"^\d+\.\d+"))


def fix_after(last: Column, fixed: Column) -> Column:
    """The fixed version one above the last affected one, if it is listed."""
    return F.when(F.array_contains(fixed, bump_last_component(last)), bump_last_component(last))


def decode(text: Column) -> Column:
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(text)


def _space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"[ \t]+", " ")


def strip_tags(html: Column) -> Column:
    """Text of markup; line breaks stay."""
    lines = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return F.regexp_replace(decode(_space(lines)), r"^\s+|\s+\z", "")


def cell_lines(html: Column) -> Column:
    """Lines of a table cell that are not empty."""
    lines = F.transform(F.split(html, r"(?i)<br\s*/?>"), strip_tags)
    return F.filter(lines, lambda s: s != "")


def labelled_cell(row: Column, label: str) -> Column:
    """The last cell of a table row with a label attribute, as markup; '' if there is none."""
    form = rf'(?s)<td[^>]*label="{label}"[^>]*>(.*?)</td>'
    return F.coalesce(F.try_element_at(F.regexp_extract_all(row, F.lit(form), 1), F.lit(-1)), F.lit(""))


def without_branch(product: Column) -> Column:
    """'Acme Server 5.7' as 'Acme Server'."""
    return F.regexp_replace(product, r"^(.*?)\s+\d[\w.]*\z", "$1")


def branch_rows(row: Column) -> Column:
    """(product, range, fixed) of a table row whose cells list products, fixed and affected versions line by line.

    Only lines that all three cells have count; a fixed version is given only with a range.
    """
    cells = [cell_lines(labelled_cell(row, n)) for n in ("Affected Product", "Fixed Versions", "Affected Versions")]
    n = F.least(*map(F.size, cells))
    lines = F.arrays_zip(*(F.slice(x, F.lit(1), n).alias(k) for x, k in zip(cells, ("p", "f", "a"), strict=True)))

    def one(line: Column) -> Column:
        found = spoken_range(line["a"])
        return F.struct(without_branch(line["p"]).alias("product"), found.alias("range"), F.when(found.isNotNull(), line["f"]).alias("fixed"))

    return F.transform(lines, one)


def html_versions(html: Column, most: int = 10) -> Column:
    """Distinct versions of three to five numbers in a page's text, the first ``most``."""
    text = F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), "&[a-z]+;", " ")
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d+\.\d+\.\d+(?:\.\d+)?(?:\.\d+)?)\b"), 1)), 1, most)


def known_severity(word: Column) -> Column:
    return F.when(F.upper(word).isin(*KNOWN_SEVERITIES), F.upper(word))


def score_and_vector(text: Column) -> Column:
    """(score, vector) of 'score/vector', cut at the first slash."""
    score = F.regexp_extract(text, r"^\s*([0-9.]+)[^/]*/", 1).try_cast("double")
    return F.when(score.isNotNull(), F.struct(score.alias("score"), F.regexp_extract(text, r"(?s)^[^/]*/(.*)\z", 1).alias("vector")))


def module_label(comment: Column) -> Column:
    return F.nullif(F.regexp_extract(comment, r"(?i)^Module\s+\S+:(\S+)\s+is enabled\z", 1), F.lit(""))


def advisory_number(title: Column) -> Column:
    """'VMSA-2024-12' and the like in capitals."""
    return F.nullif(F.upper(F.regexp_extract(title, r"(?i)(VMSA-\d{4}-\d+)", 1)), F.lit(""))


def listed_products(text: Column) -> Column:
    """Names of a list that may have been cut short."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: (F.length(s) > 2) & ~s.endswith("..."))


def page_address(link: Column) -> Column:
    """The English page of a link to an advisory."""
    return F.regexp_replace(link, r"/[a-z]{2}-[a-z]{2}/security-advisories/", "/en-us/security-advisories/")


def per_cve(advisory: Column, cve: Column) -> Column:
    """Id of an advisory's part for one CVE; the advisory's own without one."""
    return F.when(cve.isNull(), advisory).otherwise(F.concat(advisory, F.lit("/"), cve))


# What a feed's unfinished comment attribute looks like, and how it is ended.
UNFINISHED, FINISHED = r'\bcomment="([^"\n]*)\n', 'comment="{}"/>\n'


def mend_comments(xml: Column) -> Column:
    """Comment attributes that a line break ends get their closing quote, and their elements are closed."""
    return F.regexp_replace(xml, UNFINISHED, FINISHED.format("$1"))


def headed(html: Column, heading: str) -> Column:
    """A page cut before each heading (a regular expression); what precedes the first one comes first."""
    return F.split(html, f"(?={heading})")


def time_ago(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60_000)
    say = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(then.isNull(), "-").when(minutes < 1, "just now").when(minutes < 60, say(minutes, "m")).when(minutes < 1440, say(minutes / 60, "h"))
        .otherwise(say(minutes / 1440, "d"))
    )


def duration(millis: Column) -> Column:
    s = F.floor(millis / 1000 + 0.5).cast("bigint")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x + " "), b.cast("string"), F.lit(y))
    return F.when(millis.isNull() | (millis < 0), "-").when(h > 0, two(h, "h", m, "m")).when(m > 0, two(m, "m", s % 60, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))
