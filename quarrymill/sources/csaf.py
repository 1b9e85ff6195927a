"""CSAF 2.0 documents: their product trees, of any depth, and the products that their vulnerabilities name.

Joins merge: files of documents are so much smaller than their rows that Spark, going by
the files, would send whole tables through the driver.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages as G
from ..storage import written

_CVSS = "struct<baseScore: double, baseSeverity: string, vectorString: string>"
_SCORES = f"array<struct<cvss_v3: {_CVSS}, cvss_v4: {_CVSS}>>"
_NOTE = "array<struct<category: string, title: string, text: string>>"
SCHEMA = (
    "document struct<title: string, tracking: struct<id: string, initial_release_date: string>>, product_tree variant, vulnerabilities array<struct<"
    f"cve: string, notes: {_NOTE}, product_status: struct<known_affected: array<string>, known_not_affected: array<string>, fixed: array<string>>, "
    f"scores: {_SCORES}, remediations: array<struct<category: string, details: string>>, references: array<struct<url: string>>>>"
)


def read_csaf(documents: DataFrame) -> DataFrame:
    """(id, head, tree as JSON, vulnerabilities) of rows (id, text); texts that are no JSON objects give no row."""
    d = documents.select("id", F.from_json("text", SCHEMA).alias("d")).where("d.document is not null or d.product_tree is not null or d.vulnerabilities is not null")
    return d.select("id", F.col("d.document").alias("head"), F.to_json("d.product_tree").alias("tree"), F.coalesce("d.vulnerabilities", F.array().cast(d.schema["d"].dataType["vulnerabilities"].dataType)).alias("vulnerabilities"))


class _Number(str):
    """A number as its document writes it."""


def _text(x) -> str | None:
    """A value as text: strings bare, all else as JSON."""
    if x is None or isinstance(x, str):
        return x
    inner = lambda v: _text(v) if isinstance(v, (_Number, dict, list)) else json.dumps(v, ensure_ascii=False)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{inner(v)}" for k, v in x.items()) + "}"
    return "[" + ",".join(map(inner, x)) + "]" if isinstance(x, list) else json.dumps(x)


def collect_branches(tree: str | None):
    """(path, category, name, product_id, product, family) of each branch below a product tree, given as JSON, in the tree's order.

    A stack holds what is still to visit, so depth is free.
    """
    root = json.loads(tree, parse_int=_Number, parse_float=_Number) if tree else None
    field = lambda v, n: v.get(n) if isinstance(v, dict) else None
    stack = [((), None, root)]
    while stack:
        path, family, v = stack.pop()
        if path:
            category, name, product = _text(field(v, "category")), _text(field(v, "name")), field(v, "product")
            family = name if category == "product_name" else family
            yield path, category, name, _text(field(product, "product_id")) or None, _text(field(product, "name")), family
        below = field(v, "branches")
        if isinstance(below, list):
            stack.extend(((*path, i), family, below[i]) for i in range(len(below) - 1, -1, -1))


#: Nodes that leave Python in one batch; one document may have any number.
_BATCH = 50_000
_NODE = {"pos": pa.int32(), "path": pa.list_(pa.int32()), "category": pa.string(), "name": pa.string(), "product_id": pa.string(), "product": pa.string(), "family": pa.string()}


def _branches(batches, kinds: dict):
    first = 0 if "path" in kinds else 1
    for batch in batches:
        at, rows = [], []

        def out(ids=batch.column("id"), at=at, rows=rows):
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [ids.take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True))]
            at.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["id", *kinds])

        for i, tree in enumerate(batch.column("tree").to_pylist()):
            for pos, node in enumerate(collect_branches(tree)):
                at.append(i)
                rows.append((pos, *node[first:]))
                if len(rows) == _BATCH:
                    yield out()
        yield out()


def product_nodes(parsed: DataFrame, paths: bool = True) -> DataFrame:
    """A row per branch: id, pos (its place in the tree's order), path (positions from the root), category, name, product_id, product and family.

    Paths are long; without ``paths`` they are left out. ``family`` is the name of the nearest branch of category product_name, the branch itself included.
    """
    kinds = {n: t for n, t in _NODE.items() if paths or n != "path"}
    texts = "category string, name string, product_id string, product string, family string"
    schema = f"id {parsed.schema['id'].dataType.simpleString()}, pos int, {'path array<int>, ' if paths else ''}{texts}"
    return parsed.select("id", "tree").mapInArrow(lambda batches: _branches(batches, kinds), schema)


def _last(nodes: DataFrame, *values: Column) -> DataFrame:
    """One row per document and product id: the last one of the tree."""
    return nodes.groupBy("id", "product_id").agg(F.max_by(F.struct(*values), "pos").alias("v")).select("id", "product_id", "v.*")


def range_map(nodes: DataFrame) -> DataFrame:
    """(id, product_id, family, op, version): op and version from a comparison at the end of the branch's name.

    A version branch without one stands for all versions (op and version null).
    """
    found = nodes.withColumn("c", G.trailing_comparison(F.col("name"))).where("product_id is not null and family <> '' and (c is not null or category in ('product_version', 'product_version_range'))")
    return _last(found, F.col("family"), F.col("c.op").alias("op"), F.col("c.version").alias("version"))


def named_map(nodes: DataFrame) -> DataFrame:
    """(id, product_id, family, version): both read from the product's full name."""
    name = F.col("product")
    version = F.coalesce(*(F.nullif(F.regexp_extract(name, form, 1), F.lit("")) for form in (r"(?i)[\s+](\d[\d.]+[a-z0-9]*)\z", r"(?i)\s+v?(\d+\.\d[\d.]*\S*)\z")))
    short = name
    for form in (r"(?i)^Oracle\s+", r"(?i)\s+v?\d[\d.]*\S*\z", r"(?i)\s+Version\s*\S*\z"):
        short = F.regexp_replace(short, form, "")
    return _last(nodes.where("product_id is not null"), F.coalesce(F.nullif(F.trim(short), F.lit("")), name).alias("family"), version.alias("version"))


def names(nodes: DataFrame, vendor: str) -> DataFrame:
    """(id, names): the product names that a document's tree knows."""
    own = {"fortinet": F.when(F.col("category") == "product", F.array("name")), "cisco": F.array("product")}
    named = own.get(vendor, F.array(F.when(F.col("category").isin("product_name", "product"), F.col("name")), F.col("product")))
    return nodes.select("id", F.explode(named).alias("n")).where("n <> ''").groupBy("id").agg(F.collect_set("n").alias("names"))


def statuses(parsed: DataFrame) -> DataFrame:
    """A row per product id that a vulnerability lists: id, vuln (its place), kind, nth (place among those of its kind), product_id.

    Not affected ids come before fixed ones, both of kind ``fixed``; ``affected`` ids count where a document lists them first.
    """
    v = parsed.select("id", F.posexplode("vulnerabilities").alias("vuln", "v"))
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    lists = F.array(
        F.struct(F.lit("affected").alias("kind"), some(F.col("v.product_status.known_affected")).alias("ids")),
        F.struct(F.lit("not_affected").alias("kind"), some(F.col("v.product_status.known_not_affected")).alias("ids")),
        F.struct(F.lit("fixed").alias("kind"), F.concat(some(F.col("v.product_status.known_not_affected")), some(F.col("v.product_status.fixed"))).alias("ids")),
    )
    rows = v.select("id", "vuln", F.inline(lists)).select("id", "vuln", "kind", F.posexplode("ids").alias("nth", "product_id"))
    return rows


def _first_listed(listed: DataFrame) -> DataFrame:
    place = F.col("vuln").cast("bigint") * (1 << 32) + F.col("nth")
    rows = listed.where("kind = 'affected'").groupBy("id", "product_id").agg(F.min(place).alias("at"))
    return rows.select("id", "product_id", F.shiftright("at", 32).cast("int").alias("vuln"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("nth"))


_PRODUCT = ("product", "version_start", "version_end", "last_affected", "version_fixed", "versions", "patch_available")


def _product(product: Column, start=None, end=None, last=None, fixed=None, exact=None, patch=None) -> list[Column]:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    versions = F.array().cast("array<string>") if exact is None else F.when(exact.isNull(), F.array().cast("array<string>")).otherwise(F.array(exact))
    patched = (F.lit(False) if fixed is None else fixed.isNotNull()) if patch is None else patch
    return [c.alias(n) for n, c in zip(_PRODUCT, (product, text(start), text(end), text(last), text(fixed), versions, patched), strict=True)]


def _ranged(known: DataFrame) -> DataFrame:
    """Products by the tree's ranges; a family's first fixed range in the same vulnerability is its fixed version.

    known: affected and fixed product ids (id, vuln, nth, kind) with their family, op and version.
    """
    fixes = known.where("kind = 'fixed' and op in ('>=', '>') and version is not null").groupBy("id", "vuln", "family").agg(F.min_by("version", "nth").alias("fix"))
    rows = known.where("kind = 'affected'").join(fixes.hint("merge"), ["id", "vuln", "family"], "left")
    version = F.col("version")
    return rows.select("id", "vuln", "nth", *_product(F.col("family"), None, F.when(F.col("op") == "<", version), F.when(F.col("op") == "<=", version), F.col("fix")))


def _behind(vendor: str, name: Column) -> Column:
    """What a product id says behind the product's name."""
    rest = F.substring("product_id", F.length(name) + 1, F.length("product_id"))
    return F.trim(F.regexp_replace(rest, r"^[-\s]+", "")) if vendor == "cisco" else F.trim(rest)


def _with_name(rows: DataFrame, known: DataFrame, vendor: str) -> DataFrame:
    """Rows with the longest known name that the id starts with; one vendor's older ids end with a blank and a version."""
    ident = F.col("product_id")
    rows = rows.join(known.hint("merge"), "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    if vendor == "cisco":
        fits = F.filter("names", lambda n: (ident == n) | ident.startswith(F.concat(n, F.lit(" "))) | ident.startswith(F.concat(n, F.lit("-"))))
        name = G.longest_name(ident, fits)
    elif vendor == "paloalto":
        name = F.coalesce(G.longest_name(ident, F.col("names")), F.nullif(F.regexp_extract(ident, r"(?s)^(.+) [^ ]*\z", 1), F.lit("")))
    else:
        name = G.longest_name(ident, F.col("names"))
    return rows.withColumn("name", name).where("name is not null").drop("names")


def _named(listed: DataFrame, known: DataFrame, vendor: str) -> DataFrame:
    """Products by what their ids say."""
    kind = "fixed" if vendor == "paloalto" else "not_affected"
    rest = F.col("rest")
    fixes = _with_name(listed.where(F.col("kind") == kind), known, vendor).withColumn("rest", _behind(vendor, F.col("name")))
    if vendor == "fortinet":
        fixes = fixes.withColumn("rest", G.named_versions(F.col("product_id"), F.col("name"))["exact"]).where(rest.rlike(r"^\d+\.\d+\.\d+"))
    else:
        fixes = fixes.where(rest.rlike(r"^\d"))
    fixes = fixes.groupBy("id", "vuln").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "rest"))), lambda x: x["rest"]).alias("fixes"))
    rows = _with_name(_first_listed(listed), known, vendor).join(fixes.hint("merge"), ["id", "vuln"], "left").withColumn("fixes", F.coalesce("fixes", F.array().cast("array<string>")))
    any_fix = F.size("fixes") > 0
    if vendor == "fortinet":
        s = F.col("s")
        rows = rows.withColumn("s", G.named_versions(F.col("product_id"), F.col("name"))).where("s is not null")
        fixed = F.when(s["exact"].isNull(), G.fixed_in_branch(s["start"], F.col("fixes")))
        return rows.select("id", "vuln", "nth", *_product(F.col("name"), s["start"], s["end"], s["last"], fixed, s["exact"], F.when(s["exact"].isNotNull(), any_fix).otherwise(fixed.isNotNull())))
    rows = rows.withColumn("rest", _behind(vendor, F.col("name")))
    branch = F.substring_index("rest", ".", 2)
    in_branch = F.get(F.filter("fixes", lambda v: v.startswith(F.concat(branch, F.lit(".")))), 0)
    if vendor == "cisco":
        return rows.select("id", "vuln", "nth", *_product(F.col("name"), F.nullif(rest, F.lit("")), fixed=in_branch))
    plain, c = rest.rlike(r"^\d[\d.]+\z"), G.comparison(rest)
    one = lambda yes, no=None: F.when(plain, yes) if no is None else F.when(plain, yes).otherwise(no)
    return rows.select(
        "id", "vuln", "nth",
        *_product(F.col("name"), one(rest), one(F.coalesce(in_branch, G.next_minor(branch)), c["end"]), one(F.lit(None), c["last"]), one(in_branch, c["fixed"]), None, one(in_branch.isNotNull(), any_fix)),
    )


def affected_products(parsed: DataFrame, vendor: str) -> DataFrame:
    """A row per affected product of a document (``parsed`` is gone through several times): id, vuln and nth (its place), product, bounds, versions, patch_available.

    A product id counts once, where it is listed first. One vendor's documents
    name ranges in the tree; those of its documents that don't are read like the others', by the ids' texts.
    """
    nodes = product_nodes(parsed, paths=False)
    listed = statuses(parsed)
    if vendor == "oracle":
        rows = listed.where("kind = 'affected'").join(named_map(nodes).hint("merge"), ["id", "product_id"])
        first = rows.groupBy("id", "vuln", "family", "version").agg(F.min("nth").alias("nth"))
        return first.select("id", "vuln", "nth", *_product(F.col("family"), exact=F.col("version"), patch=F.lit(True)))
    if vendor != "paloalto":
        return _named(listed, names(nodes, vendor), vendor)
    either = _first_listed(listed).withColumn("kind", F.lit("affected")).unionByName(listed.where("kind = 'fixed'"))
    known = written(either.join(range_map(nodes).hint("merge"), ["id", "product_id"]).drop("product_id"), "ranges")
    by_tree = known.where("kind = 'affected'").select("id").distinct()
    rest = written(parsed.select("id", "tree", "vulnerabilities").join(by_tree.hint("merge"), "id", "left_anti"), "by-name")
    return _ranged(known).unionByName(_named(statuses(rest), names(product_nodes(rest, paths=False), vendor), vendor))


def best_score(vulnerabilities: Column, newer: bool = False) -> Column:
    """The first of the highest scores of all entries, as (baseScore, baseSeverity, vectorString)."""
    each = F.flatten(F.transform(vulnerabilities, lambda v: F.coalesce(v["scores"], F.array().cast(_SCORES))))
    each = F.transform(each, lambda s: F.coalesce(s["cvss_v3"], s["cvss_v4"]) if newer else s["cvss_v3"])
    higher = lambda best, s: F.when(s.isNotNull() & (best.isNull() | (best["baseScore"] == 0) | (s["baseScore"] > best["baseScore"])), s).otherwise(best)
    return F.aggregate(each, F.lit(None).cast(_CVSS), higher)


def _note(vuln: Column, test) -> Column:
    return F.get(F.filter(F.coalesce(vuln["notes"], F.array().cast(_NOTE)), test), 0)["text"]


def _edges(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def csaf_advisories(documents: DataFrame, vendor: str) -> DataFrame:
    """A row per advisory with its affected products in order; documents (id, text), id being the advisory's.

    One vendor's documents are collections: there a row per CVE, named by both.
    Advisories without affected products give no row.
    """
    return advisories(written(read_csaf(documents), "csaf"), vendor)


def advisories(parsed: DataFrame, vendor: str) -> DataFrame:
    """``csaf_advisories`` of documents that ``read_csaf`` has read; they are gone through several times."""
    products = affected_products(parsed, vendor)
    per_vuln = vendor == "oracle"
    key = ["id", "vuln"] if per_vuln else ["id"]
    listed = products.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("vuln", "nth", F.struct(*_PRODUCT).alias("p")))), lambda x: x["p"]).alias("products"))
    released = F.try_to_timestamp("head.tracking.initial_release_date").alias("published_at")
    if per_vuln:
        v = parsed.select("id", released, F.posexplode("vulnerabilities").alias("vuln", "v")).where("v.cve <> ''")
        s = best_score(F.array("v"))
        rows = v.select(
            *key, "published_at", F.concat("id", F.lit("-"), "v.cve").alias("external_id"), F.col("v.cve").alias("cve_id"),
            F.coalesce(_edges(_note(F.col("v"), lambda n: n["category"] == "summary")), F.concat(F.upper("id"), F.lit(": "), F.col("v.cve"))).alias("summary"),
            F.upper(s["baseSeverity"]).alias("severity"), s["baseScore"].alias("score"), s["vectorString"].alias("vector"),
            F.concat(F.lit("https://www.oracle.com/security-alerts/"), "id", F.lit(".html")).alias("url"), F.lit(None).cast("string").alias("workaround"), F.lit(None).cast("string").alias("solution"),
        )
        return rows.join(listed.hint("merge"), key).drop(*key)
    first = F.get("vulnerabilities", F.lit(0))
    s = best_score(F.col("vulnerabilities"), newer=vendor == "paloalto")
    if vendor == "paloalto":
        summary, workaround = (lambda n: n["category"].isin("summary", "description")), (lambda n: (n["category"] == "workaround") | F.lower(n["title"]).contains("workaround"))
        fixes, page = ("vendor_fix", "mitigation"), "https://security.paloaltonetworks.com/"
    else:
        summary, workaround = (lambda n: n["category"] == "summary"), (lambda n: n["title"] == "Workarounds")
        fixes, page = ("vendor_fix",), "https://fortiguard.fortinet.com/psirt/"
    way = _note(first, workaround)
    fix = F.get(F.filter(F.coalesce(first["remediations"], F.array().cast("array<struct<category: string, details: string>>")), lambda r: r["category"].isin(*fixes)), 0)["details"]
    rows = parsed.select(
        "id", released, F.col("id").alias("external_id"), first["cve"].alias("cve_id"), _edges(_note(first, summary)).alias("summary"), s["baseSeverity"].alias("severity"), s["baseScore"].alias("score"), s["vectorString"].alias("vector"),
        F.coalesce(F.get(first["references"], 0)["url"], F.concat(F.lit(page), "id")).alias("url"), _edges(way if vendor == "paloalto" else F.when(way != "N/A", way)).alias("workaround"), fix.alias("solution"),
    )
    return rows.join(listed.hint("merge"), key).drop(*key)


def cisco_advisories(listed: DataFrame, documents: DataFrame) -> DataFrame:
    """Advisories of a vendor's list with the products of their CSAF documents (id, text), where there are some.

    ``listed``: advisoryId, advisoryTitle, summary, sir, cves, cvssBaseScore, publicationUrl, workarounds, firstPublished and
    affectedProducts, as the vendor gives them. Without products of a document, a listed one stands for the vendor's all.
    """
    parsed = written(read_csaf(documents), "csaf")
    products = affected_products(parsed, "cisco").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vuln", "nth", F.struct(*_PRODUCT).alias("p")))), lambda x: x["p"]).alias("products"))
    each = F.flatten(F.transform("vulnerabilities", lambda v: F.transform(F.coalesce(v["scores"], F.array().cast(_SCORES)), lambda s: s["cvss_v3"]["vectorString"])))
    vectors = parsed.select("id", F.get(F.filter(each, lambda x: x != ""), 0).alias("vector"))
    rows = listed.withColumnRenamed("advisoryId", "id").join(vectors.hint("merge"), "id", "left").join(products.hint("merge"), "id", "left")
    whole = F.array(F.struct(*_product(F.lit("cisco"))))
    none = F.array().cast(products.schema["products"].dataType)
    return rows.select(
        F.col("id").alias("external_id"), F.get("cves", F.lit(0)).alias("cve_id"), F.col("advisoryTitle").alias("summary"), F.col("summary").alias("description"),
        F.upper("sir").alias("severity"), F.col("cvssBaseScore").try_cast("double").alias("score"), "vector",
        F.col("publicationUrl").alias("url"), F.when(F.col("workarounds") != "No workarounds available", F.col("workarounds")).alias("workaround"), F.try_to_timestamp("firstPublished").alias("published_at"),
        F.when(F.size(F.coalesce("products", none)) > 0, F.col("products")).when(F.col("affectedProducts").isNotNull(), whole).otherwise(none).alias("products"),
    )

