"""Version constraints as sorted sets of disjoint intervals of integer forms: array<struct<lo, hi>>, hi exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import MAJOR, normalize_version

TYPE = "array<struct<lo: bigint, hi: bigint>>"
#: Bounds of the set of all versions; the least step between integer forms is 1.
LEAST, MOST = -(2**62), 2**62
MINOR, PATCH = MAJOR // 1000, MAJOR // 1_000_000

_COMPARATOR = r"(?:\^|~>?|[<>]=?|=)?\s*[vV]?(?:\d+|[xX*])(?:\.(?:\d+|[xX*]))*(?:[-+][0-9A-Za-z.-]+)?"


def _interval(lo, hi) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def _none() -> Column:
    return F.array().cast(TYPE)


def everything() -> Column:
    return F.array(_interval(F.lit(LEAST), F.lit(MOST)))


def union(*sets: Column) -> Column:
    """All versions of any set. Intervals may come in any order, overlap or be empty."""
    rows = F.array_sort(F.filter(F.concat(*sets), lambda x: x["lo"] < x["hi"]))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(_interval(last["lo"], F.greatest(last["hi"], x["hi"]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= x["lo"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(rows, _none(), step)


def intersection(a: Column, b: Column) -> Column:
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: _interval(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"])))))
    return union(both)


def complement(a: Column) -> Column:
    """All versions that are not in a set that ``union`` made."""
    ends = F.concat(F.array(F.lit(LEAST).cast("bigint")), F.transform(a, lambda x: x["hi"]))
    starts = F.concat(F.transform(a, lambda x: x["lo"]), F.array(F.lit(MOST).cast("bigint")))
    return union(F.zip_with(ends, starts, lambda lo, hi: _interval(lo, hi)))


def difference(a: Column, b: Column) -> Column:
    return intersection(a, complement(b))


def covers(a: Column, b: Column) -> Column:
    """Whether every version of b is in a."""
    return F.size(difference(b, a)) == 0


def holds(a: Column, version: Column) -> Column:
    """Whether the set has a version, given in its integer form."""
    return F.exists(a, lambda x: (x["lo"] <= version) & (version < x["hi"]))


def _parts(version: Column) -> tuple[Column, Column, Column]:
    """Its integer form with missing numbers as 0, how many numbers are stated before an x, and its first three numbers."""
    numbers = F.regexp_extract(version, r"^((?:\d+\.)*\d+)?", 1)
    count = F.when(numbers == "", 0).otherwise(F.size(F.split(numbers, r"\.")))
    whole = F.regexp_replace(version, r"(?:^|\.)[xX*].*\z", "")
    at = lambda k: F.coalesce(F.get(F.split(numbers, r"\."), k).try_cast("bigint"), F.lit(0))
    return F.when(count == 0, F.lit(0)).otherwise(normalize_version(whole)), count, F.array(at(0), at(1), at(2))


def _next(version: Column, keep: Column) -> Column:
    """The least version whose first ``keep`` (0 to 3) numbers are greater; 0: there is none."""
    _, _, n = _parts(version)
    return (
        F.when(keep <= 0, F.lit(MOST)).when(keep == 1, (n[0] + 1) * MAJOR).when(keep == 2, n[0] * MAJOR + (n[1] + 1) * MINOR)
        .otherwise(n[0] * MAJOR + n[1] * MINOR + (n[2] + 1) * PATCH)
    )


def _one(token: Column) -> Column:
    """The interval of a comparator such as '^1.2', '>=3', '18.x' or '1.2.3'; null if its version has no integer form."""
    sign = F.regexp_extract(token, r"^(\^|~>?|[<>]=?|=)?", 1)
    version = F.regexp_replace(token, r"^(?:\^|~>?|[<>]=?|=)?\s*[vV]?", "")
    v, count, n = _parts(version)
    behind = F.when(count >= 3, v + 1).otherwise(_next(version, count))
    # A caret holds the first number that is not 0.
    held = F.when((n[0] > 0) | (count <= 1), 1).when((n[1] > 0) | (count == 2), 2).otherwise(3)
    least, most = F.lit(LEAST), F.lit(MOST)
    got = (
        F.when(sign == "^", _interval(v, _next(version, F.least(held, count)))).when(sign.startswith("~"), _interval(v, _next(version, F.least(F.lit(2), count))))
        .when(sign == ">=", _interval(v, most)).when(sign == ">", _interval(behind, most)).when(sign == "<", _interval(least, v)).when(sign == "<=", _interval(least, behind))
        .otherwise(_interval(F.when(count == 0, least).otherwise(v), behind))
    )
    return F.when(v.isNotNull(), got)


def npm_intervals(text: Column) -> Column:
    """The set of '20.x || ^18.12.1 || >=16 <16.5 || 1.2 - 1.4'; an alternative that says something else has no versions."""
    alternatives = F.split(F.coalesce(text, F.lit("||")), r"\|\|")

    def one(raw: Column) -> Column:
        spread = F.regexp_replace(raw, r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
        found = F.regexp_extract_all(spread, F.lit(_COMPARATOR), 0)
        rest = F.trim(F.regexp_replace(spread, _COMPARATOR, ""))
        each = F.transform(found, _one)
        both = F.aggregate(each, _interval(F.lit(LEAST), F.lit(MOST)), lambda a, x: _interval(F.greatest(a["lo"], x["lo"]), F.least(a["hi"], x["hi"])))
        clear = (rest == "") & ((F.size(found) > 0) | (F.trim(raw) == "")) & ~F.exists(each, lambda x: x.isNull())
        return F.when(text.isNotNull() & clear, F.array(both)).otherwise(_none())

    return union(F.flatten(F.transform(alternatives, one)))


def vers_intervals(text: Column) -> Column:
    """The set of 'vers:npm/>=1.0|<2.0|!=1.5|3.1'; null if it is no such text or one of its versions has no integer form.

    Comparisons are taken in order of their versions: a lower bound opens a range unless one is open, an upper bound
    closes it, or opens it at the least version if it is the first; single versions are added, and '!=' ones taken away.
    """
    listed = F.filter(F.transform(F.split(F.regexp_extract(text, r"(?s)^vers:[^/]+/(.*)\z", 1), r"\|"), lambda x: F.regexp_replace(x, r"\s+", "")), lambda x: x != "")
    sign = lambda x: F.regexp_extract(x, r"^(!=|[<>]=?|=)?", 1)
    rows = F.array_sort(F.transform(listed, lambda x: F.struct(normalize_version(F.regexp_replace(x, r"^(?:!=|[<>]=?|=)?", "")).alias("v"), sign(x).alias("op"))))
    point = lambda ops: F.transform(F.filter(rows, lambda r: r["op"].isin(*ops)), lambda r: _interval(r["v"], r["v"] + 1))
    start = F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(True).alias("first"), _none().alias("out"))

    def step(acc: Column, r: Column) -> Column:
        opens = F.coalesce(acc["at"], F.when(r["op"] == ">", r["v"] + 1).otherwise(r["v"]))
        begin = F.coalesce(acc["at"], F.when(acc["first"], F.lit(LEAST)))
        end = F.when(r["op"] == "<=", r["v"] + 1).otherwise(r["v"])
        closed = F.when(begin.isNotNull(), F.concat(acc["out"], F.array(_interval(begin, end)))).otherwise(acc["out"])
        up = r["op"].startswith(">")
        return F.struct(F.when(up, opens).alias("at"), F.lit(False).alias("first"), F.when(up, acc["out"]).otherwise(closed).alias("out"))

    bounds = F.filter(rows, lambda r: r["op"].isin("<", "<=", ">", ">="))
    ranges = F.aggregate(bounds, start, step, lambda acc: F.when(acc["at"].isNotNull(), F.concat(acc["out"], F.array(_interval(acc["at"], F.lit(MOST))))).otherwise(acc["out"]))
    only_not = (F.size(rows) > 0) & F.forall(rows, lambda r: r["op"] == "!=")
    some = F.when(only_not | (text.rlike(r"^vers:[^/]+/\*\z")), everything()).otherwise(union(ranges, point(("", "="))))
    clear = text.rlike(r"^vers:[^/]+/.") & (text.rlike(r"^vers:[^/]+/\*\z") | ~F.exists(rows, lambda r: r["v"].isNull()))
    return F.when(clear, difference(some, union(point(("!=",)))))
