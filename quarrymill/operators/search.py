"""Searches over the three sources (OSV, NVD, advisories), their union by route, and one result per master.

Requests are rows (request_id, package_name, version, ecosystem); a batch of any
size is one job. Source rows carry the master they belong to (null: none yet)
and their own id.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ecosystems as E
from ..functions import products as P
from ..functions import versions as V

HIT = ["request_id", "source", "master_no", "own_id", "fixed_version", "approximate", "own"]
#: What a source row says itself, for hits whose master isn't there (yet), and what a master says.
OWN = {"severity": "string", "score": "double", "vector": "string", "summary": "string", "published_at": "timestamp"}
MASTER = OWN | {"is_kev": "boolean", "epss": "double", "epss_percentile": "double"}
#: A range over more major versions than this is met by every version of its package.
SPAN = 8


def prepared(requests: DataFrame) -> DataFrame:
    """Requests with ecosystem spelling, integer version and what decides their route."""
    r = requests.withColumn("ecosystem", E.normalize_ecosystem(F.col("ecosystem"))).withColumn("v", V.normalize_version(F.col("version")))
    eco = F.col("ecosystem")
    return r.withColumns({"distro": E.is_distro(eco), "dpkg": F.coalesce(E.is_dpkg_style(eco), F.lit(False)), "language": E.is_language(eco), "vendor": E.rpm_vendor(eco)})


def _column(rows: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)


def _source(affected: DataFrame) -> DataFrame:
    """Source rows with what they say themselves put together."""
    return affected.withColumn("own", F.struct(*(_column(affected, c, t) for c, t in OWN.items())))


def _hits(joined: DataFrame, source: str, approximate: Column) -> DataFrame:
    return joined.select("r.request_id", F.lit(source).alias("source"), "a.master_no", "a.own_id", "a.fixed_version", approximate.alias("approximate"), "a.own")


def _named(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _buckets(prefix: str, low: Column, high: Column) -> Column:
    """Keys of a row whose range goes from ``low`` to ``high`` (the versions' first numbers); of open and very wide ranges the one that all ask for."""
    low, high = low.cast("bigint"), high.cast("bigint")
    narrow = (high >= low) & (high - low < SPAN)
    return F.when(narrow, F.transform(F.sequence(low, high), lambda n: _named(prefix, n))).otherwise(F.array(F.lit(prefix + "*")))


def _near(prefix: str, n: Column) -> list[Column]:
    """Keys that a request with the first number ``n`` asks for."""
    return [F.lit(prefix + "*"), _named(prefix, n)]


def _keys(*cases: tuple[Column, Column]) -> Column:
    """All keys of the cases that hold."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*(F.when(test, F.coalesce(keys, none)).otherwise(none) for test, keys in cases))))


#: Parts into which the rows of a package are dealt, so that one with many rows is not one task's.
PARTS = 16


def _dealt(affected: DataFrame) -> DataFrame:
    """Source rows where they are matched; what is made of them is made there, so that it need not travel."""
    return affected.withColumn("part", F.pmod(F.xxhash64("own_id"), F.lit(PARTS))).repartition("package_name", "part")


def _match(requests: DataFrame, affected: DataFrame, also: Column, source: str, approximate: Column, name: str = "package_name") -> DataFrame:
    """Requests with the rows of their package that share a key with them, where ``also`` holds.

    A key says a way to match and a version or its first number, so a row's bounds are compared with versions near
    them alone. Rows leave their partition once, whatever number of keys they have, and requests, which are fewer, are hashed.
    """
    r = requests.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    same = (F.col(f"r.{name}") == F.col("a.package_name")) & (F.col("r.part") == F.col("a.part"))
    near = r.hint("shuffle_hash").alias("r").join(affected.alias("a"), same & F.arrays_overlap("r.keys", "a.keys"))
    both = near.select(F.struct("r.*").alias("r"), F.struct("a.*").alias("a"), F.explode(F.array_intersect("r.keys", "a.keys")).alias("key"))
    return _hits(both.where(also), source, approximate)


def _way(*ways: str) -> Column:
    return F.substring("key", 1, 1).isin(*ways)


def _if(ways: str, test: Column) -> Column:
    """``test``, for matches by one of these ways."""
    return ~_way(*ways) | F.coalesce(test, F.lit(False))


def _int_low(column: str) -> Column:
    return F.floor(F.coalesce(F.col(column), F.lit(0)) / V.MAJOR)


def search_osv(requests: DataFrame, affected: DataFrame) -> DataFrame:
    """affected: package_name, ecosystem, kind, introduced, fixed_version, last_affected (texts and *_int), versions, master_no, own_id, and any of ``OWN``.

    Distributions match by listed versions, dpkg-like ones by ranges too; others by
    integer ranges, or by the list where a row has nothing else. Without an
    ecosystem, rows of distributions are left out.
    """
    text = lambda n: F.nullif(F.col(f"{n}_version"), F.lit(""))
    start, end = text("introduced"), F.coalesce(text("fixed"), text("last_affected"))
    listed = lambda p: F.transform("versions", lambda x: _named(p, x))
    ranged, bounded, yes = F.col("kind") != "versions", F.coalesce("introduced_version", "fixed_version", "last_affected_version").isNotNull(), F.lit(True)
    low = F.when(start.isNull(), 0).otherwise(V.leading_number(start))
    a = _source(_dealt(affected)).withColumns({
        **{f"{n}_key": V.dpkg_evr(text(n)) for n in ("introduced", "fixed", "last_affected")},
        "upstream": ~reduce(or_, (F.coalesce(F.col("ecosystem").startswith(p), F.lit(False)) for p in E.DISTRO_PREFIXES)),
        "keys": _keys(
            (yes, F.array(F.lit("w"))), (yes, listed("v")), (~ranged, listed("l")), (ranged, _buckets("i", _int_low("introduced_int"), F.floor(F.coalesce("fixed_int", "last_affected_int") / V.MAJOR))),
            (bounded, F.array(F.lit("D"))), (bounded, _buckets("d", low, V.leading_number(end))),
        ),
    })
    v, version, dpkg, distro = (F.col(c) for c in ("v", "version", "dpkg", "distro"))
    n = V.leading_number(version)
    stated, plain = version.isNotNull(), ~distro & ~dpkg
    r = requests.withColumns({
        "k": F.when(dpkg, V.dpkg_evr(version)),
        "keys": _keys(
            (~stated | plain & v.isNull(), F.array(F.lit("w"))), (stated & (distro | dpkg), F.array(_named("v", version))), (stated & dpkg & n.isNull(), F.array(F.lit("D"))), (stated & dpkg & n.isNotNull(), F.array(*_near("d", n))),
            (stated & plain & v.isNotNull(), F.array(_named("l", version), *_near("i", F.floor(v / V.MAJOR)))),
        ),
    })
    k = F.col("r.k")
    inside = lambda name, test: F.when(F.coalesce(F.col(f"a.{name}_version"), F.lit("")) == "", True).otherwise(test(F.col(f"a.{name}_key")))
    by_dpkg = inside("introduced", lambda x: k >= x) & inside("fixed", lambda x: k < x) & inside("last_affected", lambda x: k <= x)
    by_int = V.range_matches(F.col("r.v"), F.col("a.introduced_int"), F.col("a.fixed_int"), F.col("a.last_affected_int"))
    where = F.when(F.col("r.ecosystem").isNull(), F.col("a.upstream")).otherwise(F.col("a.ecosystem").startswith(F.col("r.ecosystem")))
    return _match(r, a, where & _if("dD", by_dpkg) & _if("i", by_int), "osv", ~F.col("r.distro") & F.col("r.v").isNull())


def search_nvd(requests: DataFrame, affected: DataFrame) -> DataFrame:
    """affected: package_name, ecosystem, *_int, master_no, own_id, fixed_version, and any of ``OWN``; under all names of the product."""
    a = _source(_dealt(affected)).withColumn("keys", F.concat(F.array(F.lit("w")), _buckets("i", _int_low("introduced_int"), F.floor(F.coalesce("fixed_int", "last_affected_int") / V.MAJOR))))
    named = requests.where(~F.col("distro") & ~F.col("language")).withColumn("name", F.explode(P.product_names(F.col("package_name"))))
    r = named.withColumn("keys", F.when(F.col("v").isNull(), F.array(F.lit("w"))).otherwise(F.array(*_near("i", F.floor(F.col("v") / V.MAJOR)))))
    same = F.col("r.ecosystem").isNull() | F.col("a.ecosystem").startswith(F.col("r.ecosystem"))
    by_int = V.range_matches(F.col("r.v"), F.col("a.introduced_int"), F.col("a.fixed_int"), F.col("a.last_affected_int"))
    return _match(r, a, same & _if("i", by_int), "nvd", F.col("r.v").isNull(), "name")


def search_advisory(requests: DataFrame, affected: DataFrame) -> DataFrame:
    """affected: package_name, vendor, version_start, version_end, *_int, versions, master_no, own_id, fixed_version, and any of ``OWN``.

    rpm routes compare with rpm's order and their vendor's rows alone; others
    match a range that a row has, or its list. Rows of module streams only serve rpm routes.
    """
    start, end = F.col("version_start"), F.col("version_end")
    plain, ended = end.isNull() | ~end.contains(".module+"), end.isNotNull()
    bounded = plain & F.coalesce("version_start_int", "version_end_int", "last_affected_int").isNotNull()
    low = F.when(start.isNull(), 0).otherwise(V.leading_number(start))
    a = _source(_dealt(affected)).withColumns({
        "lo": V.rpm_evr(start), "hi": V.rpm_evr(end),
        "keys": _keys(
            (F.lit(True), F.array(F.lit("V"))), (ended, F.array(F.lit("R"))), (ended, _buckets("r", low, V.leading_number(end))), (plain, F.array(F.lit("w"))), (plain, F.transform("versions", lambda x: _named("l", x))),
            (bounded, _buckets("i", _int_low("version_start_int"), F.floor(F.coalesce("version_end_int", "last_affected_int") / V.MAJOR))),
        ),
    })
    version, v, rpm = F.col("version"), F.col("v"), F.col("vendor").isNotNull()
    n, stated = V.leading_number(version), version.isNotNull()
    wanted = requests.where(F.col("vendor").isNotNull() | ~F.col("distro") & ~F.col("language"))
    r = wanted.withColumns({
        "k": F.when(rpm, V.rpm_evr(version)),
        "keys": _keys(
            (rpm & ~stated, F.array(F.lit("V"))), (rpm & stated & n.isNull(), F.array(F.lit("R"))), (rpm & stated & n.isNotNull(), F.array(*_near("r", n))), (~rpm & ~stated, F.array(F.lit("w"))),
            (~rpm & stated, F.array(_named("l", version))), (~rpm & stated & v.isNotNull(), F.array(*_near("i", F.floor(v / V.MAJOR)))),
        ),
    })
    k = F.col("r.k")
    by_rpm = (k < F.col("a.hi")) & (F.col("a.version_start").isNull() | (k >= F.col("a.lo")))
    by_int = V.range_matches(F.col("r.v"), F.col("a.version_start_int"), F.col("a.version_end_int"), F.col("a.last_affected_int"))
    also = _if("VrR", F.col("a.vendor") == F.col("r.vendor")) & _if("rR", by_rpm) & _if("i", by_int)
    return _match(r, a, also, "advisory", F.col("r.vendor").isNull() & F.col("r.version").isNotNull() & F.col("r.v").isNull())


def united(*hits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (h.select(*HIT) for h in hits))


def results(hits: DataFrame, masters: DataFrame) -> DataFrame:
    """One row per request and master: where it was found, all ids it goes by, the first fixed version, and what is known of it.

    masters: master_no, cve_id, osv_id, advisory_id, and any of ``MASTER``. A hit without a master stands for itself,
    with what its first source row says, and is not known to be exploited.
    Sources come in the order OSV, NVD, advisories; within one, own ids decide what comes first.
    """
    order = F.struct(F.array_position(F.array(*map(F.lit, ("osv", "nvd", "advisory"))), F.col("source")).alias("rank"), "own_id", "fixed_version", "source", "approximate", "own")
    key = F.coalesce(F.concat(F.lit("m"), F.col("master_no")), F.col("own_id"))
    found = hits.groupBy("request_id", key.alias("id")).agg(F.first("master_no").alias("master_no"), F.array_sort(F.collect_set(order)).alias("h"))
    first = F.get("h", F.lit(0))
    # Only what is shown goes to the masters.
    found = found.select(
        "request_id", "id", "master_no", first["own"].alias("own"), first["source"].alias("by"), first["approximate"].alias("approximate"), first["rank"].alias("rank"),
        F.array_distinct(F.transform("h", lambda x: x["source"])).alias("sources"), F.transform("h", lambda x: x["own_id"]).alias("own_ids"),
        F.get(F.filter(F.transform("h", lambda x: x["fixed_version"]), lambda x: x.isNotNull() & (x != "")), F.lit(0)).alias("fixed_version"),
    )
    told = masters.select("master_no", "cve_id", "osv_id", "advisory_id", F.struct(*(_column(masters, c, t) for c, t in MASTER.items())).alias("told"))
    joined = found.join(told, "master_no", "left")
    own_id = F.get("own_ids", F.lit(0))
    without = {"is_kev": F.lit(False)}
    said = [F.when(F.col("told").isNotNull(), F.coalesce(F.col(f"told.{c}"), without.get(c, F.lit(None)))).otherwise(F.col(f"own.{c}") if c in OWN else without.get(c, F.lit(None))).alias(c) for c in MASTER]
    return joined.select(
        "request_id", "id",
        F.coalesce("cve_id", "osv_id", "advisory_id", own_id).alias("external_id"),
        F.when(F.col("cve_id").isNotNull(), "nvd").when(F.col("osv_id").isNotNull(), "osv").otherwise(F.col("by")).alias("source"),
        "sources", F.array_distinct(F.array_compact(F.concat(F.array("cve_id", "osv_id", "advisory_id"), "own_ids"))).alias("aliases"),
        "fixed_version", "approximate", *said, F.struct("rank", own_id.alias("own_id"), F.col("id").alias("id")).alias("place"),
    )


def paged(found: DataFrame, limit: int | Column = 50, offset: int | Column = 0) -> DataFrame:
    """Of each request's results, in their order, those of one page; limit and offset may be columns of the requests."""
    w = Window.partitionBy("request_id").orderBy("place")
    end = (F.lit(limit) if isinstance(limit, int) else limit) + (F.lit(offset) if isinstance(offset, int) else offset)
    nth = found.withColumn("nth", F.row_number().over(w))
    return nth.where((F.col("nth") > offset) & (F.col("nth") <= end))


def questions(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, members): requests that ask the same, but for their id, as one under the least of their ids, and the ids that each stands for.

    Requests whose id occurs more than once stand for themselves, as their results are put together by id.
    """
    others = [c for c in requests.columns if c != "request_id"]
    marked = requests.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("request_id")) > 1)
    alone = F.when(F.col("several"), F.struct("request_id"))
    one = marked.groupBy(*others, alone.alias("alone")).agg(F.min("request_id").alias("asked_as"), F.collect_set(F.struct("request_id")).alias("asked_by"))
    members = one.groupBy("asked_as").agg(F.array_distinct(F.flatten(F.collect_list("asked_by"))).alias("asked_by"))
    return one.select(F.col("asked_as").alias("request_id"), *others), members


def answered(found: DataFrame, members: DataFrame) -> DataFrame:
    """What was found for a question, for each request that asks it."""
    same = F.col("request_id").eqNullSafe(F.col("asked_as"))
    rows = found.join(members.hint("shuffle_hash"), same).drop("request_id")
    return rows.select(F.inline("asked_by"), *(c for c in rows.columns if c not in ("asked_as", "asked_by"))).select(*found.columns)


def search_questions(asked: DataFrame, osv: DataFrame, nvd: DataFrame, advisory: DataFrame, masters: DataFrame) -> DataFrame:
    """All results of requests as they are, each for itself."""
    r = prepared(asked)
    return results(united(search_osv(r, osv), search_nvd(r, nvd), search_advisory(r, advisory)), masters)


def search_all(requests: DataFrame, osv: DataFrame, nvd: DataFrame, advisory: DataFrame, masters: DataFrame) -> DataFrame:
    """All results of all requests; ``paged`` cuts them (50 for a single search, 500 for each package of a batch).

    What is asked more than once is searched once; ``questions``, ``search_questions`` and ``answered`` let results be cut before requests share them.
    """
    asked, members = questions(requests)
    return answered(search_questions(asked, osv, nvd, advisory, masters), members)


def found_by(found: DataFrame, source: str) -> DataFrame:
    """Ids, in capitals, of results that a source contributed to."""
    return found.where(F.array_contains("sources", source)).select("request_id", F.upper("external_id").alias("external_id")).distinct()


def search_cpe(names: DataFrame, affected: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows of a platform name (request_id, cpe), paged for each request without merging them; a name is searched once."""
    asked, members = questions(names.select("request_id", "cpe"))
    got = E.parse_cpe(F.col("cpe"))
    r = asked.select("request_id", got["vendor"].alias("vendor"), F.explode(P.product_names(got["product"])).alias("name"), V.normalize_version(got["version"]).alias("v"))
    hit = F.col("r.v").isNull() | V.range_matches(F.col("r.v"), F.col("a.introduced_int"), F.col("a.fixed_int"), F.col("a.last_affected_int"))
    rows = r.alias("r").join(affected.alias("a"), (F.col("r.vendor") == F.col("a.vendor")) & (F.col("r.name") == F.col("a.package_name")) & hit)
    w = Window.partitionBy("request_id").orderBy("own_id", "row_id")
    page = rows.select("r.request_id", "a.own_id", "a.row_id").withColumn("nth", F.row_number().over(w)).where((F.col("nth") > offset) & (F.col("nth") <= offset + limit)).drop("nth")
    return answered(page, members)


def lookup(asked: DataFrame, masters: DataFrame, advisories: DataFrame, osv: DataFrame) -> DataFrame:
    """The master of each id: by one of its own ids, else by an advisory's, else by an OSV record's (external_id, master_no)."""
    own = [masters.select(F.col(c).alias("ident"), "master_no", F.lit(1).alias("way")) for c in ("cve_id", "osv_id", "advisory_id")]
    far = [x.select(F.col("external_id").alias("ident"), "master_no", F.lit(k).alias("way")) for k, x in ((2, advisories), (3, osv))]
    names = reduce(DataFrame.unionByName, [*own, *far]).where("ident is not null and master_no is not null")
    best = names.join(asked, "ident", "left_semi").groupBy("ident").agg(F.min(F.struct("way", "master_no")).alias("best"))
    return asked.join(best, "ident", "left").select("ident", F.col("best.master_no").alias("master_no"), F.col("best.way").alias("way"))
