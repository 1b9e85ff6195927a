"""Version ordering as columns: an integer form, and sort keys for rpm and dpkg rules.

A key column orders like the comparator it stands for, so version matching is
an ordinary range predicate and needs no row-level function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COMPONENT_DIGITS = 6
#: Factor of the major version in the integer form.
MAJOR = 1_000_000_000


def _number(text: Column) -> Column:
    """Digits as a bigint; '' and null are 0. Call only where the length is known to be small."""
    return F.coalesce(F.expr("bigint(null)"), F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(text.try_cast("bigint")))


def strip_epoch(v: Column) -> Column:
    return F.regexp_replace(v, r"^\d+:", "")


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` evaluated once however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


def normalize_version(v: Column) -> Column:
    """major·10^9 + minor·10^6 + patch·10^3 + release; null if a component has over six digits, one less for pre-releases.

    Plain dotted numbers, which most versions are, take a short way.
    """
    plain = v.rlike(r"^\d{1,6}(?:\.\d{1,6})*\z")
    number = lambda k: F.coalesce(F.nullif(F.split_part(v, F.lit("."), F.lit(k)), F.lit("")).try_cast("bigint"), F.lit(0))
    quick = number(1) * 1_000_000_000 + number(2) * 1_000_000 + number(3) * 1000
    update = r"^(\d+\.\d+) U(\d+)([a-z]?)\z"

    def as_update(s: Column) -> Column:
        letter = F.regexp_extract(s, update, 3)
        mark = F.when(letter == "", "").otherwise(F.concat(F.lit("-"), F.ascii(letter) - 96))
        return F.when(s.rlike(update), F.concat(F.regexp_extract(s, update, 1), F.lit("."), F.regexp_extract(s, update, 2), mark)).otherwise(s)

    def general(s: Column) -> Column:
        pre = s.rlike(r"\d-[a-zA-Z]")
        parts = F.split(F.regexp_replace(F.split_part(s, F.lit("-"), F.lit(1)), "[^0-9.]", ""), r"\.")
        release = F.when(pre, "").otherwise(F.regexp_extract(F.split_part(s, F.lit("-"), F.lit(2)), r"^(\d+)", 1))
        digits = F.concat(F.transform(F.slice(F.concat(parts, F.array_repeat(F.lit(""), 3)), 1, 3), lambda x: F.regexp_replace(x, "^0+", "")), F.array(F.regexp_replace(release, "^0+", "")))

        def total(d: Column) -> Column:
            return F.when(~F.exists(d, lambda x: F.length(x) > MAX_COMPONENT_DIGITS), F.aggregate(d, F.lit(0).cast("bigint"), lambda acc, x: acc * 1000 + _number(x)))

        return let(let(digits, total), lambda t: F.when(pre & (t > 0), t - 1).otherwise(t))

    spelled = F.regexp_replace(strip_epoch(v), r"(?i)_update_?(\d+)", r".$1")
    return F.when(plain, quick).when(v.isNotNull(), let(let(spelled, as_update), general)).cast("bigint")


def is_valid_version(v: Column) -> Column:
    return v.rlike(r"^(\d+)\.(\d+)\.(\d+)(-[\w.-]+)?(\+[\w.-]+)?\z")


def range_matches(v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Predicate on integer forms: introduced inclusive, fixed exclusive, last inclusive where there is no fixed."""
    upper = (fixed > v) | (fixed.isNull() & (last.isNull() | (last >= v)))
    return (introduced.isNull() | (introduced <= v)) & upper


def version_in_range(v: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """Of version strings; a bound that is present must have an integer form, and all present bounds hold."""
    n = normalize_version(v)

    def bound(text: Column, test) -> Column:
        key = normalize_version(text)
        return text.isNull() | (text == "") | (key.isNotNull() & test(key))

    return F.coalesce(n.isNotNull() & bound(introduced, lambda k: n >= k) & bound(fixed, lambda k: n < k) & bound(last, lambda k: n <= k), F.lit(False))


def _padded(digits: Column) -> Column:
    """Digits so that text order is numeric order: their count, itself preceded by its own length, then the digits without leading zeros."""
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    size = F.length(bare).cast("string")
    return F.concat(F.lpad(F.length(size).cast("string"), 2, "0"), size, bare)


def rpm_key(v: Column) -> Column:
    """Text whose binary order is rpm's order of a version or release: numbers over letters, more segments over fewer."""
    tokens = F.regexp_extract_all(v, F.lit("([0-9]+|[A-Za-z]+)"), 1)
    coded = F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("2"), _padded(t))).otherwise(F.concat(F.lit("1"), t, F.lit("!"))))
    return F.concat(F.array_join(coded, ""), F.when(v.rlike(r"[^0-9A-Za-z]\z"), "0").otherwise(""))


def dpkg_key(v: Column) -> Column:
    """Text whose binary order is dpkg's: '~' before the end, the end before letters, letters before the rest."""
    text = F.when(v == "", "0").otherwise(v)
    runs = F.regexp_extract_all(text, F.lit(r"([^0-9]*[0-9]*)"), 1)

    def code(run: Column) -> Column:
        sign = F.regexp_extract(run, r"^([^0-9]*)", 1)
        other = F.regexp_replace(sign, r"([^A-Za-z~])", "é$1")
        digits = F.regexp_extract(run, r"([0-9]*)\z", 1)
        return F.concat(F.translate(other, "~", "\u0001"), F.lit("\u0002"), _padded(F.when(digits == "", "0").otherwise(digits)))

    return F.concat(F.array_join(F.transform(F.filter(runs, lambda r: r != ""), code), ""), F.lit("\u0002"))


def _epoch(v: Column) -> Column:
    """The number before a colon as text that orders like it, whatever its length; 0 if there is none."""
    head = F.regexp_extract(F.regexp_extract(v, r"^([^:]*):", 1), r"^\s*(\d+)", 1)
    return _padded(F.when(head == "", "0").otherwise(head))


def _evr(v: Column, key) -> Column:
    rest = F.regexp_replace(v, r"^[^:]*:", "")
    cut = rest.contains("-")
    version = F.when(cut, F.regexp_extract(rest, r"(?s)^(.*)-[^-]*\z", 1)).otherwise(rest)
    release = F.when(cut, F.regexp_extract(rest, r"-([^-]*)\z", 1)).otherwise("")
    return F.struct(_epoch(v).alias("epoch"), key(version).alias("version"), key(release).alias("release"))


def rpm_evr(v: Column) -> Column:
    """(epoch, version key, release key), which Spark compares field by field."""
    return _evr(v, rpm_key)


def dpkg_evr(v: Column) -> Column:
    return _evr(v, dpkg_key)


def leading_number(version: Column) -> Column:
    """The first number of a version without an epoch, where it decides before all else; else null."""
    return F.regexp_extract(version, r"^0*(\d{1,9})(?:[^\d:][^:]*)?\z", 1).try_cast("bigint")


def compare(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def rpm_range_matches(v: Column, start: Column, end: Column) -> Column:
    """Start inclusive if present, end exclusive and required."""
    return F.coalesce((end != "") & (rpm_evr(v) < rpm_evr(end)) & (start.isNull() | (start == "") | (rpm_evr(v) >= rpm_evr(start))), F.lit(False))


def dpkg_row_matches(v: Column, listed: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """A listed version matches; else some bound must be present (even empty), and bounds that are not empty must hold."""
    def holds(text: Column, test) -> Column:
        return F.coalesce(text, F.lit("")).isin("") | test(dpkg_evr(text))

    bounded = introduced.isNotNull() | fixed.isNotNull() | last.isNotNull()
    inside = holds(introduced, lambda k: dpkg_evr(v) >= k) & holds(fixed, lambda k: dpkg_evr(v) < k) & holds(last, lambda k: dpkg_evr(v) <= k)
    return F.coalesce(F.array_contains(listed, v), F.lit(False)) | F.coalesce(bounded & inside, F.lit(False))


#: A number of any length that a decimal holds.
_WIDE = "decimal(38,0)"


def _moved(digits: Column, step: int) -> Column:
    """Digits moved by ``step`` as text; null if that would be negative, or if they are longer than a decimal holds."""
    n = digits.try_cast(_WIDE) + F.lit(step).cast("decimal(2,0)")
    return F.when((F.length(digits) < 38) & (n >= 0), n.cast("string"))


def bump_patch(v: Column, step: int) -> Column:
    """x.y.z with z moved by ``step``; null if there are no three numbers or z would be negative."""
    form = r"^(\d+)\.(\d+)\.(\d+)"
    return F.when(v.rlike(form), F.concat(F.regexp_extract(v, form, 1), F.lit("."), F.regexp_extract(v, form, 2), F.lit("."), _moved(F.regexp_extract(v, form, 3), step)))


def bump_last_number(v: Column, step: int) -> Column:
    """The last run of digits moved by ``step``; null if there is none or it would be negative."""
    form = r"^(.*?)(\d+)(\D*)\z"
    return F.when(v.rlike(form), F.concat(F.regexp_extract(v, form, 1), _moved(F.regexp_extract(v, form, 2), step), F.regexp_extract(v, form, 3)))


def bump_last_component(v: Column) -> Column:
    last = F.regexp_extract(v, r"(?:^|\.)(\d+)\z", 1)
    return F.when(last != "", F.concat(F.regexp_extract(v, r"^((?:.*\.)?)\d+\z", 1), _moved(last, 1)))


# Products whose fixed version tells the major line; those of FAMILIES have two-number majors.
TWO_NUMBER_MAJORS = [
    "httpd",
    "mysql", "mysql-server", "mysql-libs", "mysql-common", "mysql-errmsg", "mysql-devel", "mysql-test", "mysql-test-data", "mysql-bench", "mysql-embedded", "mysql-embedded-devel",
    "mariadb", "mariadb-server", "mariadb-devel", "mariadb-embedded", "mariadb-embedded-devel", "mariadb-test", "mariadb-common", "mariadb-errmsg", "mariadb-libs", "mariadb-backup",
    "mariadb-bench", "mariadb-client-utils", "mariadb-gssapi-server", "mariadb-oqgraph-engine", "mariadb-pam", "mariadb-server-galera", "mariadb-server-utils",
    "php", "php-cli", "php-common", "php-fpm", "php-mysqlnd", "php-mysql", "php-bcmath", "php-dba", "php-dbg", "php-devel", "php-embedded", "php-enchant", "php-ffi", "php-gd",
    "php-gmp", "php-imap", "php-intl", "php-json", "php-ldap", "php-mbstring", "php-ncurses", "php-odbc", "php-opcache", "php-pdo", "php-pgsql", "php-process", "php-pspell",
    "php-recode", "php-snmp", "php-soap", "php-tidy", "php-xml", "php-xmlrpc", "php-zts",
]
ONE_NUMBER_MAJORS = ["nodejs", "postgresql"]


def bare_floor(product: Column, end: Column) -> Column:
    """Lowest version of the line that a fix without a stated start belongs to, for known products."""
    two = F.regexp_extract(end, r"^(\d+\.\d+)\.", 1)
    one = F.regexp_extract(end, r"^(\d+)\.", 1)
    old = F.regexp_extract(end, r"^(9\.\d+)\.", 1)
    found = F.when(product.isin(TWO_NUMBER_MAJORS), two).when((product == "postgresql") & (old != ""), old).when(product.isin(ONE_NUMBER_MAJORS) & (one != ""), F.concat(one, F.lit(".0")))
    return F.nullif(found, F.lit(""))


def module_floor(label: Column, end: Column) -> Column:
    """A module stream's label as a lowest version, unless it would lie above the fixed version."""
    start = F.when(label.contains("."), label).otherwise(F.concat(label, F.lit(".0")))
    return F.when(normalize_version(start) > normalize_version(end), None).otherwise(start)
