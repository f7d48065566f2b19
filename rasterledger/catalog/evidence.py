"""Queries over evidence tables."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import lookup
from ..functions.ranking import running_number
from ..operators import evidence as ev
from ..operators import package_rules as pr
from .pixels import rounded
from .registry import query, sql_case, sql_list

c = F.col
KINDS = vocab.VISUAL_ARTIFACTS["always"] + vocab.VISUAL_ARTIFACTS["pptx"] + vocab.VISUAL_ARTIFACTS["html"]


@query("missing_artifacts", f"""
WITH k AS (SELECT [{sql_list(KINDS)}] AS ks), e AS (SELECT o_orderkey AS slide, unnest(ks) AS kind FROM orders, k),
p AS (SELECT l_orderkey AS slide, ks[(l_linenumber*5 + l_partkey) % 9 + 1] AS kind FROM lineitem, k),
g AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.slide = e.slide AND p.kind = e.kind)),
s AS (SELECT *, max(CASE kind WHEN 'source.png' THEN 1 ELSE 0 END) OVER (PARTITION BY slide) AS s FROM g)
SELECT slide, kind, 'missing_artifact' AS signal, 'missing_content' AS issue_type, 'blocking' AS severity FROM s WHERE s = 0 OR kind = 'source.png'""")
def _(t):
    kinds = F.array(*map(F.lit, KINDS))
    present = t.lineitem.select(c("l_orderkey").alias("slide"), F.get(kinds, ((c("l_linenumber") * 5 + c("l_partkey")) % 9).cast("int")).alias("kind"))
    return ev.missing_artifacts(t.orders.select(c("o_orderkey").alias("slide")), present, KINDS, "source.png")


@query("crop_manifest_overlay", """
WITH b AS (SELECT concat(name, '_', CAST(part_no AS VARCHAR), '_', CAST(supp_no AS VARCHAR)) AS name, slide, x, y, w, h, content_type, reconstruction_reason, reason FROM fx_crops),
p AS (SELECT * FROM b WHERE reconstruction_reason IS NOT NULL), m AS (SELECT name, slide, x, y, w - 10 AS w, CAST(NULL AS BIGINT) AS h, upper(content_type) AS content_type FROM b WHERE reason IS NOT NULL)
SELECT coalesce(p.name, m.name) AS name, coalesce(m.slide, p.slide) AS slide, coalesce(m.x, p.x) AS x, coalesce(m.y, p.y) AS y, coalesce(m.w, p.w) AS w, coalesce(m.h, p.h) AS h,
  coalesce(m.content_type, p.content_type) AS content_type FROM p FULL JOIN m ON p.name = m.name""", "fx_crops")
def _(t):
    b = t.fx_crops.withColumn("name", F.concat("name", F.lit("_"), c("part_no").cast("string"), F.lit("_"), c("supp_no").cast("string")))
    cols = ["name", "slide", "x", "y", "w", "h", "content_type"]
    plan = b.where("reconstruction_reason IS NOT NULL").select(*cols)
    manifest = b.where("reason IS NOT NULL").select("name", "slide", "x", "y", (c("w") - 10).alias("w"), F.lit(None).cast("bigint").alias("h"), F.upper("content_type").alias("content_type"))
    return ev.overlay(plan, manifest, "name")


MINIMUMS = {"text": 8.0, "editable": 12.0, "textLength": 80.0}


CLAIMS_SQL = """
WITH a AS (SELECT l_orderkey AS slide, count(*)::DOUBLE AS n, sum(l_quantity) AS q, (sum(l_partkey % 100))::DOUBLE / 1000 AS r FROM lineitem GROUP BY 1),
m AS (SELECT slide, 'text' AS metric, n + CASE slide % 4 WHEN 0 THEN 1 ELSE 0 END AS claimed, n AS actual FROM a
  UNION ALL SELECT slide, 'editable', n*3 - 1, n*3 FROM a UNION ALL SELECT slide, 'textLength', q, q FROM a
  UNION ALL SELECT slide, 'totalCropAreaRatio', r + CASE slide % 6 WHEN 0 THEN 0.03::DOUBLE ELSE 0.01::DOUBLE END, r FROM a),
v AS (SELECT *, CASE metric WHEN 'text' THEN 8 WHEN 'editable' THEN 12 WHEN 'textLength' THEN 80 END AS low FROM m)
SELECT slide, metric, round(claimed, 6) AS claimed, round(actual, 6) AS actual, 'claim_exceeds_actual' AS rule FROM v WHERE NOT metric LIKE '%Ratio' AND claimed > actual
UNION ALL SELECT slide, metric, round(claimed, 6), round(actual, 6), 'ratio_disagrees' FROM v WHERE metric LIKE '%Ratio' AND abs(claimed - actual) > 0.02::DOUBLE
UNION ALL SELECT slide, metric, round(claimed, 6), round(actual, 6), 'below_minimum' FROM v WHERE actual < low AND slide NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("reconcile_claims", CLAIMS_SQL)
def claims(t):
    a = t.lineitem.groupBy(c("l_orderkey").alias("slide")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"), (F.sum(c("l_partkey") % 100) / 1000).alias("r"))

    def long(**m):
        return a.select("slide", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in m.items()])).alias("e")).select("slide", "e.metric", c("e.v").alias("v"))

    claims = long(text=c("n") + F.when(c("slide") % 4 == 0, 1).otherwise(0), editable=c("n") * 3 - 1, textLength=c("q"),
                  totalCropAreaRatio=c("r") + F.when(c("slide") % 6 == 0, 0.03).otherwise(0.01)).withColumnRenamed("v", "claimed")
    actuals = long(text=c("n"), editable=c("n") * 3, textLength=c("q"), totalCropAreaRatio=c("r")).withColumnRenamed("v", "actual")
    excused = t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("slide")).distinct()
    return rounded(ev.reconcile(claims, actuals, excused, MINIMUMS), "claimed", "actual")


HASHES_SQL = """
WITH e AS (SELECT slide//3 AS slide, path || '#' || slide AS path, CASE WHEN slide % 11 = 0 THEN sha256(content || '!') WHEN slide % 19 = 0 THEN NULL ELSE sha256(content) END AS x,
   CASE WHEN present THEN sha256(content) END AS a FROM fx_artifacts)
SELECT slide, count(x) AS checked, count(*) FILTER (a = x) AS matched, count(*) FILTER (x IS NOT NULL AND a IS NULL) AS missing,
  count(x) > 0 AND count(x) = count(*) FILTER (a = x) AND count(*) FILTER (x IS NOT NULL AND a IS NULL) = 0 AS hashes_valid FROM e GROUP BY slide"""


@query("verify_hashes", HASHES_SQL, "fx_artifacts")
def hashes(t):
    a = t.fx_artifacts.withColumn("path", F.concat("path", F.lit("#"), c("slide").cast("string")))
    expected = a.select(F.floor(c("slide") / 3).alias("slide"), "path", F.when(c("slide") % 11 == 0, F.sha2(F.concat("content", F.lit("!")), 256))
                        .when(c("slide") % 19 == 0, F.lit(None).cast("string")).otherwise(F.sha2("content", 256)).alias("expected_sha"))
    return ev.verify_hashes(expected, a.where("present").select("path", "content"))


@query("stale_outputs", "SELECT run_id, output_no, part_no, supp_no FROM fx_outputs WHERE mtime + INTERVAL 1 MILLISECOND < run_start", "fx_outputs")
def _(t):
    runs = t.orders.select(c("o_orderkey").alias("run_id"), c("o_orderdate").alias("run_start"))
    outputs = t.lineitem.select(c("l_orderkey").alias("run_id"), c("l_linenumber").alias("output_no"), c("l_partkey").alias("part_no"), c("l_suppkey").alias("supp_no"), c("l_shipdate").alias("mtime"))
    return ev.stale_outputs(runs, outputs).select("run_id", "output_no", "part_no", "supp_no")


def provenance_docs(t):
    d = c("doc_id")
    docs = t.documents.select(
        d.alias("slide"), F.when(d % 13 == 0, F.lit("other.v2")).otherwise(F.lit(vocab.TEXT_REGION_SCHEMA)).alias("schema_version"),
        F.when(d % 7 == 0, F.lit(None).cast("string")).when(d % 11 == 0, F.lit("abc")).when(d % 5 == 0, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("source_hash"),
        F.when(d % 17 == 0, F.lit(None).cast("bigint")).when(d % 9 == 0, F.lit(0).cast("bigint")).otherwise(d % 100 + 1).alias("width"),
        F.when(d % 17 == 0, F.lit(None).cast("bigint")).otherwise(c("n_chars")).alias("height"),
        F.when(d % 17 == 0, F.lit(None).cast("string")).when(d % 8 == 0, F.lit("inch")).otherwise(F.lit("source_px")).alias("units"))
    images = t.documents.where("source <> 'src4'").select(d.alias("slide"), F.sha2("text", 256).alias("actual_sha"), (d % 100 + F.when(d % 6 == 0, 2).otherwise(1)).alias("actual_width"), c("n_chars").alias("actual_height"))
    return docs, images


PROV = f"""
WITH d AS (SELECT doc_id AS slide, CASE WHEN doc_id % 13 = 0 THEN 'other.v2' ELSE '{vocab.TEXT_REGION_SCHEMA}' END AS v,
   CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'abc' WHEN doc_id % 5 = 0 THEN sha256(text || '?') ELSE upper(sha256(text)) END AS hash,
   CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 100 + 1 END AS w, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS h,
   CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 8 = 0 THEN 'inch' ELSE 'source_px' END AS u,
   CASE WHEN source <> 'src4' THEN sha256(text) END AS a, doc_id % 100 + CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS aw, n_chars AS ah FROM documents)
SELECT slide, 'unsupported_schema' AS rule, 'error' AS level FROM d WHERE v <> '{vocab.TEXT_REGION_SCHEMA}'
UNION ALL SELECT slide, 'missing_hash', '{{soft}}' FROM d WHERE hash IS NULL UNION ALL SELECT slide, 'malformed_hash', 'error' FROM d WHERE hash = 'abc'
UNION ALL SELECT slide, 'missing_coordinate_space', '{{soft}}' FROM d WHERE u IS NULL UNION ALL SELECT slide, 'bad_width', 'error' FROM d WHERE u IS NOT NULL AND w <= 0
UNION ALL SELECT slide, 'bad_height', 'error' FROM d WHERE u IS NOT NULL AND h <= 0 UNION ALL SELECT slide, 'bad_units', 'error' FROM d WHERE u = 'inch'
UNION ALL SELECT slide, 'hash_mismatch', 'error' FROM d WHERE a IS NOT NULL AND length(hash) = 64 AND lower(hash) <> a
UNION ALL SELECT slide, 'size_mismatch', 'error' FROM d WHERE a IS NOT NULL AND u IS NOT NULL AND (w <> aw OR h <> ah)"""


@query("provenance_check", PROV.format(soft="error"))
def _(t):
    return ev.check_provenance(*provenance_docs(t), strict=True)


@query("provenance_check_legacy", PROV.format(soft="warning"))
def _(t):
    return ev.check_provenance(*provenance_docs(t), strict=False)


def _share(cond):
    return f"round(sum(CASE WHEN {cond} THEN w*h ELSE 0 END)::DOUBLE / {vocab.CANVAS_W * vocab.CANVAS_H}, 6)"


COVERAGE_SQL = f"""SELECT slide, count(*) AS crops, {_share('true')} AS total_ratio, round(max(w*h)::DOUBLE / {vocab.CANVAS_W * vocab.CANVAS_H}, 6) AS largest_ratio,
  {_share('content_type IN (' + sql_list(vocab.TEXTUAL_TYPES) + ')')} AS text_ratio, {_share('content_type IN (' + sql_list(vocab.DENSE_TYPES) + ')')} AS dense_ratio,
  {_share('content_type IN (' + sql_list(vocab.PHOTO_TYPES) + ')')} AS photo_ratio FROM fx_crops GROUP BY slide"""


@query("crop_coverage", COVERAGE_SQL, "fx_crops")
def _(t):
    return ev.crop_coverage(t.fx_crops)


OBJ_CTE = """no AS (SELECT slide, ord, coalesce(type, 'shape') AS type, floor(x*1000+0.5)/1000 AS x, CASE WHEN isnan(y) THEN 0.0::DOUBLE ELSE floor(y*1000+0.5)/1000 END AS y,
  floor(w*1000+0.5)/1000 AS w, floor(h*1000+0.5)/1000 AS h, length(txt)::BIGINT AS text_length, coalesce(editable, true) AS editable FROM fx_objects)"""


@query("normalize_objects", f"WITH {OBJ_CTE} SELECT * FROM no", "fx_objects")
def _(t):
    return ev.normalize_objects(t.fx_objects.drop("tag"))


CATS = list(dict.fromkeys(vocab.OBJECT_CATEGORY.values()))


def _cat_sql(n):
    types = [k for k, v in vocab.OBJECT_CATEGORY.items() if v == n]
    return f"count(*) FILTER (type IN ({sql_list(types)})) AS {n}"


@query("object_counts", f"""WITH {OBJ_CTE} SELECT slide, {', '.join(_cat_sql(n) for n in CATS)}, count(*) FILTER (editable) AS editable_objects,
  (sum(CASE WHEN type = 'text' AND editable THEN text_length ELSE 0 END))::BIGINT AS editable_text_length FROM no GROUP BY slide""", "fx_objects")
def _(t):
    return ev.object_counts(ev.normalize_objects(t.fx_objects.drop("tag")))


@query("duplicate_keys", """SELECT slide, id, region_key FROM (SELECT slide, id, region_key, row_number() OVER (PARTITION BY slide, id ORDER BY region_key) AS n FROM fx_regions) q WHERE n > 1""", "fx_regions")
def _(t):
    return ev.duplicates(t.fx_regions.select("slide", "id", "region_key"), ["slide", "id"], ["region_key"])


@query("merge_partitions", """
WITH u AS (SELECT name, slide, part_no, supp_no, CASE WHEN allow_large_crop THEN 0 ELSE 1 END AS worker FROM fx_crops)
SELECT name, slide, part_no, supp_no, worker, row_number() OVER (PARTITION BY name ORDER BY worker, part_no, supp_no) > 1 AS duplicate FROM u""", "fx_crops")
def _(t):
    base = t.fx_crops
    cols = ["name", "slide", "part_no", "supp_no"]
    return ev.merge_partitions([base.where("allow_large_crop").select(*cols), base.where("NOT allow_large_crop").select(*cols)], "name", ["part_no", "supp_no"])


@query("changed_keys", """
WITH r AS (SELECT DISTINCT p_partkey AS key, sha256(p_name) AS sha256, 'v1' AS fingerprint FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT p_partkey AS key, CASE WHEN p_size % 4 = 0 THEN sha256(p_brand) ELSE sha256(p_name) END AS sha256, CASE WHEN p_size % 7 = 0 THEN 'v0' ELSE 'v1' END AS fingerprint FROM part)
SELECT * FROM r EXCEPT SELECT * FROM k""")
def _(t):
    req = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(c("p_partkey").alias("key"), F.sha2("p_name", 256).alias("sha256"), F.lit("v1").alias("fingerprint"))
    cache = t.part.select(c("p_partkey").alias("key"), F.when(c("p_size") % 4 == 0, F.sha2("p_brand", 256)).otherwise(F.sha2("p_name", 256)).alias("sha256"),
                          F.when(c("p_size") % 7 == 0, "v0").otherwise("v1").alias("fingerprint"))
    return ev.changed_keys(req, cache)


@query("discover_slides", """
WITH s AS (SELECT 'Slide' || doc_id || CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.JPG' ELSE '.txt' END AS p FROM documents), w AS (SELECT 'slide' || lpad(CAST(conv_id AS VARCHAR), 2, '0') AS p FROM conversations)
SELECT DISTINCT slide FROM (SELECT regexp_extract(p, '(?i)^slide([0-9]+)\\.(png|jpg|jpeg)$', 1) AS d FROM s UNION ALL SELECT regexp_extract(p, '(?i)^slide([0-9]+)$', 1) FROM w) q, LATERAL (SELECT CAST(d AS BIGINT) AS slide) z WHERE d <> ''"""
       .replace("CAST(d AS BIGINT)", "TRY_CAST(d AS BIGINT)").replace("lpad(CAST(conv_id AS VARCHAR), 2, '0')", "CASE WHEN conv_id < 10 THEN '0' ELSE '' END || conv_id"))
def _(t):
    ext = F.when(c("lang") == "en", ".png").when(c("lang") == "fr", ".JPG").otherwise(".txt")
    src = t.documents.select(F.concat(F.lit("Slide"), c("doc_id").cast("string"), ext).alias("path"))
    work = t.conversations.select(F.concat(F.lit("slide"), F.when(c("conv_id") < 10, "0").otherwise(""), c("conv_id").cast("string")).alias("path"))
    return ev.discover_slides([(src, r"(?i)^slide(\d+)\.(png|jpg|jpeg)$"), (work, r"(?i)^slide(\d+)$")])


@query("resolve_source_path", """
WITH f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'slide' || doc_id || '.png' WHEN 1 THEN 'slide' || p2 || '.png' WHEN 2 THEN 'slide-' || doc_id || '.png' WHEN 3 THEN 'slide-' || p2 || '.png' ELSE 'page' || doc_id || '.png' END AS path
   FROM (SELECT doc_id, CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id AS p2 FROM documents) q)
SELECT doc_id AS slide, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE path END AS path FROM f""")
def _(t):
    n = c("doc_id").cast("string")
    two = F.concat(F.when(c("doc_id") < 10, "0").otherwise(""), n)
    k = c("doc_id") % 5
    name = (F.when(k == 0, F.concat(F.lit("slide"), n)).when(k == 1, F.concat(F.lit("slide"), two)).when(k == 2, F.concat(F.lit("slide-"), n))
            .when(k == 3, F.concat(F.lit("slide-"), two)).otherwise(F.concat(F.lit("page"), n)))
    return ev.resolve_source(t.documents.select(c("doc_id").alias("slide")), t.documents.select(F.concat(name, F.lit(".png")).alias("path")))


@query("resolve_slide_map", """
WITH o AS (SELECT o_custkey AS deck, o_orderkey AS source, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
n AS (SELECT deck, count(*) AS n FROM o GROUP BY deck)
SELECT deck, source AS source_slide, CASE WHEN p >= 50000 THEN ord + 1 END AS physical_slide, CASE WHEN p >= 50000 THEN ord + 2 END AS html_slide, 'slide-map' AS mapping_mode, CASE WHEN p < 50000 THEN 'not in slide map' END AS error FROM o
  WHERE deck % 5 = 0 AND deck IN (SELECT deck FROM o WHERE p >= 50000)
UNION ALL SELECT deck, source, ord, ord, 'source-slides-sequential', NULL FROM o WHERE deck % 5 = 2 OR (deck % 5 = 0 AND deck NOT IN (SELECT deck FROM o WHERE p >= 50000)) OR (deck % 5 = 1 AND deck % 3 = 0 AND deck IN (SELECT deck FROM n WHERE n = 1))
UNION ALL SELECT deck, source, ord*2, ord*2, 'source-physical-slides', NULL FROM o WHERE deck % 5 = 1 AND deck % 3 <> 0
UNION ALL SELECT deck, source, NULL, NULL, 'length-mismatch', 'list lengths differ' FROM o WHERE deck % 5 = 1 AND deck % 3 = 0 AND deck IN (SELECT deck FROM n WHERE n > 1)
UNION ALL SELECT deck, source, ord, ord, 'trace', NULL FROM o WHERE deck % 5 = 3
UNION ALL SELECT deck, source, source, source, 'legacy-physical-slides', NULL FROM o WHERE deck % 5 = 4""")
def _(t):
    base = t.orders.select(c("o_custkey").alias("deck"), c("o_orderkey").alias("source"), c("o_totalprice").alias("price"))
    o = running_number(base, ["deck"], [], "source", "ord")
    k = c("deck") % 5
    requested = o.where(k <= 2).select("deck", "ord", "source")
    paired = o.where((k == 1) & ~((c("deck") % 3 == 0) & (c("ord") == 1))).select("deck", "ord", (c("ord") * 2).alias("physical"))
    mapped = o.where((k == 0) & (c("price") >= 50000)).select("deck", "source", (c("ord") + 1).alias("physical"), (c("ord") + 2).alias("html"))
    return ev.resolve_slide_map(requested, paired, mapped, o.where(k == 3).select("deck", "ord", "source"), o.where(k == 4).select("deck", c("source").alias("slide")))


@query("physical_numbering", "SELECT o_custkey AS deck, o_orderkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS physical FROM orders")
def _(t):
    return ev.physical_numbering(t.orders.select(c("o_custkey").alias("deck"), c("o_orderkey").alias("source")))


@query("style_match", """
WITH l AS (SELECT * FROM fx_profiles WHERE id IN (SELECT min(id) FROM fx_profiles GROUP BY background)),
m AS (SELECT s.id, l.id AS profile, (s.background=l.background)::INT + (s.geometry=l.geometry)::INT + (s.header=l.header)::INT + (s.step_style=l.step_style)::INT AS n FROM fx_profiles s, l),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, profile) AS rn FROM m)
SELECT id, CASE WHEN n > 0 THEN profile END AS profile, n::BIGINT AS agreeing, CASE WHEN n = 4 THEN 'high' WHEN n > 0 THEN 'partial' ELSE 'none' END AS confidence FROM r WHERE rn = 1""", "fx_profiles")
def _(t):
    p = t.fx_profiles
    library = p.join(p.groupBy("background").agg(F.min("id").alias("id")), ["background", "id"], "left_semi")
    return ev.style_match(p, library, ["background", "geometry", "header", "step_style"])


@query("shortcut_detection", """
WITH e AS (SELECT slide, concat(name, '_', CAST(part_no AS VARCHAR), '_', CAST(supp_no AS VARCHAR)) AS entry, CASE supp_no % 3 WHEN 0 THEN 'areaRatio' WHEN 1 THEN 'coveragePercent' ELSE 'height' END AS key,
   CASE supp_no % 3 WHEN 1 THEN w*h*220.0::DOUBLE/1573352 ELSE w*h*2.2::DOUBLE/1573352 END AS v, CASE WHEN supp_no % 50 = 0 THEN 'Full-Slide image' WHEN supp_no % 2 = 0 THEN 'crop of photo' ELSE 'photo' END AS text FROM fx_crops),
s AS (SELECT *, CASE WHEN key = 'areaRatio' AND v <= 1 THEN v WHEN key = 'coveragePercent' AND v <= 1 THEN v WHEN key = 'coveragePercent' AND v <= 100 THEN v/100 END AS share FROM e),
g AS (SELECT slide, entry, text, max(share) AS share FROM s GROUP BY ALL)
SELECT slide, entry, CASE WHEN text LIKE 'Full%' THEN 'full_slide_marker' ELSE 'crop_coverage' END AS finding, CASE WHEN text NOT LIKE 'Full%' THEN round(share, 6) END AS share FROM g WHERE text LIKE 'Full%' OR (text LIKE 'crop%' AND share >= 0.92::DOUBLE)""", "fx_crops")
def _(t):
    k = c("supp_no") % 3
    area = c("w") * c("h")
    e = t.fx_crops.select("slide", F.concat("name", F.lit("_"), c("part_no").cast("string"), F.lit("_"), c("supp_no").cast("string")).alias("entry"),
                          F.when(k == 0, "areaRatio").when(k == 1, "coveragePercent").otherwise("height").alias("key"),
                          F.when(k == 1, area * 220.0 / 1573352).otherwise(area * 2.2 / 1573352).cast("string").alias("value"),
                          F.when(c("supp_no") % 50 == 0, "Full-Slide image").when(c("supp_no") % 2 == 0, "crop of photo").otherwise("photo").alias("text"))
    return rounded(ev.detect_shortcuts(e), "share")


def rel_links(t):
    o = c("ord") % 6
    target = (F.when(o == 0, F.concat(F.lit(".."), "target")).when(o == 1, F.concat(F.lit("./a/.."), "target", F.lit("#top"))).when(o == 2, c("target"))
              .when(o == 3, F.lit("#only")).when(o == 4, F.concat(F.lit("../../.."), "target")).otherwise(F.concat(F.lit("http://x"), "target")))
    return t.fx_links.select("pkg", F.concat(F.lit("ppt/slides/_rels/slide"), c("page_id").cast("string"), F.lit(".xml.rels")).alias("rels_part"),
                             F.concat(F.lit("rId"), (c("ord") % 5).cast("string")).alias("rel_id"), "ord", target.alias("target"), F.when(o == 5, "External").alias("mode"))


LINK_CTE = """rl AS (SELECT pkg, 'ppt/slides/_rels/slide' || page_id || '.xml.rels' AS rels_part, 'rId' || (ord % 5) AS rel_id, ord,
  CASE ord % 6 WHEN 0 THEN '..' || target WHEN 1 THEN './a/..' || target || '#top' WHEN 2 THEN target WHEN 3 THEN '#only' WHEN 4 THEN '../../..' || target ELSE 'http://x' || target END AS target,
  CASE WHEN ord % 6 = 5 THEN 'External' END AS mode FROM fx_links),
rb AS (SELECT *, split_part(target, '#', 1) AS tt FROM rl),
rs AS (SELECT pkg, rels_part, rel_id, ord, target, mode, CASE WHEN tt = '' THEN '' ELSE list_reduce(string_split(CASE WHEN tt LIKE '/%' THEN tt ELSE 'ppt/slides/' || tt END, '/'), lambda acc, p:
   CASE WHEN p IN ('', '.') THEN acc WHEN p = '..' THEN CASE WHEN acc <> '' AND acc <> '..' AND NOT ends_with(acc, '/..') THEN regexp_replace(acc, '/?[^/]+$', '') WHEN starts_with(tt, '/') THEN acc WHEN acc = '' THEN p ELSE acc || '/' || p END
   WHEN acc = '' THEN p ELSE acc || '/' || p END, '') END AS resolved FROM rb)"""


@query("resolve_relative_paths", f"WITH {LINK_CTE} SELECT pkg, rels_part, rel_id, ord, target, resolved, NOT starts_with(resolved, '..') AS inside FROM rs", "fx_links")
def _(t):
    links = rel_links(t).drop("mode")
    return ev.resolve_targets(links)


@query("link_integrity", f"""WITH {LINK_CTE}, pt AS (SELECT DISTINCT pkg, CASE ord % 2 WHEN 1 THEN 'old/' ELSE '' END || resolved AS resolved FROM rs)
SELECT pkg, rels_part, rel_id, 'empty_target' AS rule, '' AS detail FROM rs WHERE mode IS NULL AND resolved = ''
UNION ALL SELECT pkg, rels_part, rel_id, 'missing_target', resolved FROM rs WHERE mode IS NULL AND resolved <> '' AND NOT EXISTS (SELECT 1 FROM pt WHERE pt.pkg = rs.pkg AND pt.resolved = rs.resolved)
UNION ALL SELECT pkg, rels_part, rel_id, 'duplicate_id', CAST(count(*) AS VARCHAR) FROM rs GROUP BY pkg, rels_part, rel_id HAVING count(*) > 1""", "fx_links")
def _(t):
    links = rel_links(t)
    parts = ev.resolve_targets(links).select("pkg", F.concat(F.when(c("ord") % 2 == 1, "old/").otherwise(""), "resolved").alias("part"))  # every second target has moved
    return ev.link_integrity(parts, links.drop("ord"))


EXT = {"en": ".png", "fr": ".xml", "de": ".bin"}


def doc_parts(t):
    ext = F.when(c("lang") == "en", ".png").when(c("lang") == "fr", ".xml").when(c("lang") == "de", ".bin").otherwise(".rels")
    return t.documents.select(c("source").alias("pkg"), F.concat(F.lit("ppt/part"), c("doc_id").cast("string"), ext).alias("part"), "n_chars", "doc_id")


TYPES_CTE = f"""pt AS (SELECT source AS pkg, 'ppt/part' || doc_id || {sql_case('lang', EXT, "'.rels'")} AS part, n_chars, doc_id FROM documents),
px AS (SELECT *, regexp_extract(part, '\\.([^./]+)$', 1) AS ext FROM pt),
tc AS (SELECT pkg, part, ext, CASE WHEN ext = 'bin' THEN 'warning' ELSE 'error' END AS level FROM px WHERE NOT (ext = 'xml' OR (ext = 'png' AND pkg <> 'src1')) AND n_chars >= 500)"""


def uncovered(t):
    parts = doc_parts(t)
    defaults = parts.select("pkg").distinct().withColumn("ext", F.explode(F.array(F.lit("xml"), F.lit("png")))).where("NOT (pkg = 'src1' AND ext = 'png')")
    return ev.type_coverage(parts.select("pkg", "part"), defaults, parts.where("n_chars < 500").select("pkg", "part"))


@query("declared_type_coverage", f"WITH {TYPES_CTE} SELECT * FROM tc")
def _(t):
    return uncovered(t)


@query("package_summary", f"""WITH {TYPES_CTE}, v AS (SELECT pkg, count(*) FILTER (level='error') AS errors, count(*) FILTER (level='warning') AS warnings FROM tc GROUP BY pkg),
e AS (SELECT pkg, count(*) AS entries, count(*) FILTER (ext IN ('xml','rels')) AS parsed_parts FROM px GROUP BY pkg)
SELECT pkg, entries, parsed_parts, coalesce(errors,0) AS errors, coalesce(warnings,0) AS warnings, coalesce(errors,0) = 0 AS passed FROM e LEFT JOIN v USING (pkg)""")
def _(t):
    return ev.package_summary(doc_parts(t).select("pkg", "part"), uncovered(t))




@query("numeric_attr_check", """
WITH b AS (SELECT l_orderkey AS slide, concat(l_partkey, '_', l_suppkey, '_', l_linenumber) AS part, CAST(l_partkey*1000 AS VARCHAR) AS x, CASE WHEN l_suppkey % 17 = 0 THEN 'NaN' WHEN l_suppkey % 19 = 0 THEN 'null' ELSE CAST(l_linenumber*10 AS VARCHAR) END AS y,
   CAST(l_partkey % 50 - 2 AS VARCHAR) AS cx, CASE WHEN l_suppkey % 23 = 0 THEN '1.5' ELSE CAST(l_suppkey*20000000 AS VARCHAR) END AS cy FROM lineitem),
a AS (SELECT slide, part, 'x' AS attr, x AS raw FROM b UNION ALL SELECT slide, part, 'y', y FROM b UNION ALL SELECT slide, part, 'cx', cx FROM b UNION ALL SELECT slide, part, 'cy', cy FROM b),
v AS (SELECT *, CASE WHEN regexp_full_match(raw, '-?[0-9]+') THEN CAST(raw AS BIGINT) END AS n FROM (SELECT * FROM a) q)
SELECT slide, part, attr, raw, 'non_finite' AS rule, 'error' AS level FROM v WHERE raw = 'NaN' UNION ALL SELECT slide, part, attr, raw, 'null_in_number', 'error' FROM v WHERE raw = 'null'
UNION ALL SELECT slide, part, attr, raw, 'not_a_whole_number', 'error' FROM v WHERE attr IN ('cx','cy') AND n IS NULL UNION ALL SELECT slide, part, attr, raw, 'size_not_positive', 'error' FROM v WHERE attr IN ('cx','cy') AND n <= 0
UNION ALL SELECT slide, part, attr, raw, 'negative_size', 'warning' FROM v WHERE attr IN ('cx','cy') AND n < 0 UNION ALL SELECT slide, part, attr, raw, 'extremely_large', 'warning' FROM v WHERE abs(n) > 1000000000""".replace("CAST(raw AS BIGINT)", "TRY_CAST(raw AS BIGINT)"))
def _(t):
    s = c("l_suppkey")
    y = F.when(s % 17 == 0, "NaN").when(s % 19 == 0, "null").otherwise((c("l_linenumber") * 10).cast("string"))
    cy = F.when(s % 23 == 0, "1.5").otherwise((s * 20000000).cast("string"))
    text = F.concat(F.lit('<a:off x="'), (c("l_partkey") * 1000).cast("string"), F.lit('" y="'), y, F.lit('"/><a:ext cx="'), (c("l_partkey") % 50 - 2).cast("string"), F.lit('" cy="'), cy, F.lit('"/>'))
    return ev.check_numeric_attrs(t.lineitem.select(c("l_orderkey").alias("slide"), F.concat_ws("_", "l_partkey", "l_suppkey", "l_linenumber").alias("part"), text.alias("text")))


@query("normalize_geometry", """
WITH q AS (SELECT slide, ord, x, CASE WHEN isnan(y) THEN 0.0::DOUBLE ELSE y END AS y, CASE WHEN ord % 7 = 0 THEN 0.0::DOUBLE ELSE w END AS w, CASE WHEN ord % 5 = 0 THEN 0.0::DOUBLE ELSE h END AS h FROM fx_objects),
n AS (SELECT slide, ord, CASE WHEN w < 0 THEN x + w ELSE x END AS x, CASE WHEN h < 0 THEN y + h ELSE y END AS y, abs(w) AS w, abs(h) AS h FROM q)
SELECT slide, ord, round(x, 6) AS x, y, CASE WHEN h < 1e-4 THEN greatest(w, 0.25::DOUBLE) WHEN w < 1e-4 THEN 0.0 ELSE greatest(w, 0.25::DOUBLE) END AS w, CASE WHEN h < 1e-4 THEN 0.0::DOUBLE ELSE greatest(h, 0.25::DOUBLE) END AS h,
  CASE WHEN h < 1e-4 THEN 'horizontal' WHEN w < 1e-4 THEN 'vertical' ELSE 'diagonal' END AS orientation, floor(x*(13.333::DOUBLE/1672)*1000+0.5)/1000 AS x_inch, floor(y*(13.333::DOUBLE/1672)*1000+0.5)/1000 AS y_inch,
  CASE WHEN w = 0 THEN 0.25::DOUBLE ELSE w END AS safe_w, CASE WHEN h = 0 THEN 0.25::DOUBLE ELSE h END AS safe_h, floor(greatest(w*(72*13.333::DOUBLE/1672), 0.1::DOUBLE)*1000+0.5)/1000 AS w_point FROM n""", "fx_objects")
def _(t):
    o = t.fx_objects.select("slide", "ord", "x", "y", F.when(c("ord") % 7 == 0, 0.0).otherwise(c("w")).alias("w"), F.when(c("ord") % 5 == 0, 0.0).otherwise(c("h")).alias("h"))
    return rounded(ev.normalize_geometry(o), "x")


FAULTS = [("1", "mismatched_tag"), ("2", "unclosed_tag"), ("3", "stray_end_tag"), ("4", "second_root"), ("5", "invalid_token"), ("6", "duplicate_attribute"), ("7", "unbound_prefix"), ("8", "text_outside_root"),
          ("9", "not_utf8"), ("10", "control_character"), ("11", "empty")]


def xml_parts(t):
    """Each turn of a conversation as an XML part; eleven of thirteen kinds carry one planted fault."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    kind = (c("conv_id") * 7 + c("turn")) % 13
    head = F.concat(F.lit('<?xml version="1.0"?><p:sld xmlns:p="u"><p:t n="'), c("turn").cast("string"), F.lit('">'))
    ends = {1: "</p:sld></p:t>", 2: "</p:t>", 3: "</p:t></p:sld></p:sld>", 4: "</p:t></p:sld><p/>", 5: "&</p:t></p:sld>", 6: "<p:b c='1' c='2'/></p:t></p:sld>", 7: "<q:b/></p:t></p:sld>",
            8: "</p:t></p:sld>tail", 10: "\x01</p:t></p:sld>", 12: "<!-- <p:b> & --><![CDATA[<p:b>&]]></p:t></p:sld>"}
    tail = F.lit("</p:t></p:sld>")
    for k, v in ends.items():
        tail = F.when(kind == k, F.lit(v)).otherwise(tail)
    text = F.concat(head, body, tail).cast("binary")
    bad = F.concat(F.concat(head, body).cast("binary"), F.unhex(F.lit("C3")), F.lit("</p:t></p:sld>").cast("binary"))
    return t.conversations.select(c("conv_id").alias("pkg"), F.concat(F.lit("ppt/slides/slide"), c("turn").cast("string"), F.lit(".xml")).alias("part"), F.when(kind == 9, bad).when(kind == 11, F.lit("").cast("binary")).otherwise(text).alias("content"))


@query("xml_well_formed", f"""WITH p AS (SELECT conv_id AS pkg, 'ppt/slides/slide' || turn || '.xml' AS part, (conv_id*7 + turn) % 13 AS kind,
  length('<?xml version="1.0"?><p:sld xmlns:p="u"><p:t n="">') + length(CAST(turn AS VARCHAR)) + length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g')) AS n FROM conversations)
SELECT pkg, part, {sql_case("CAST(kind AS VARCHAR)", dict(FAULTS))} AS rule,
  CAST(CASE kind WHEN 2 THEN n + 6 WHEN 3 THEN n + 14 WHEN 4 THEN n + 14 WHEN 8 THEN n + 14 WHEN 11 THEN 0 ELSE n END AS BIGINT) AS "offset",
  CASE kind WHEN 1 THEN 'p:t closed by p:sld' WHEN 2 THEN 'p:sld' WHEN 3 THEN 'p:sld' WHEN 4 THEN 'p' WHEN 5 THEN '&' WHEN 6 THEN 'p:b' WHEN 7 THEN 'q' WHEN 10 THEN 'U+0001' ELSE '' END AS detail FROM p WHERE kind NOT IN (0, 12)""")
def _(t):
    return pr.xml_errors(xml_parts(t))


ENTRIES = {"1": "[Content_Types].xml", "2": "_rels/.rels", "3": "ppt/presentation.xml", "4": "ppt/_rels/presentation.xml.rels", "5": "ppt/slides/slide1.xml", "6": "ppt/media/a.png", "7": "ppt/media/b.jpg"}


@query("package_structure", f"""WITH p AS (SELECT l_orderkey AS pkg, CASE WHEN l_suppkey % 29 = 0 THEN '_rels/.rels' ELSE {sql_case("CAST(l_linenumber AS VARCHAR)", ENTRIES)} END AS part, l_partkey % 10 * 100 AS bytes FROM lineitem),
d AS (SELECT o_orderkey AS pkg, e.ext FROM orders, (VALUES ('xml', 3), ('rels', 4), ('png', 5), ('jpg', 2)) e(ext, m) WHERE o_custkey % e.m <> 0),
k AS (SELECT DISTINCT pkg FROM p),
r AS (SELECT unnest(['[Content_Types].xml', '_rels/.rels', 'ppt/presentation.xml', 'ppt/_rels/presentation.xml.rels']) AS part)
SELECT pkg, 'missing_required_part' AS rule, part AS detail FROM k, r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pkg = k.pkg AND p.part = r.part)
UNION ALL SELECT pkg, 'no_slide_parts', '' FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pkg = k.pkg AND p.part = 'ppt/slides/slide1.xml')
UNION ALL SELECT pkg, 'missing_default', e.ext FROM k, (VALUES ('xml'), ('rels')) e(ext) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pkg = k.pkg AND d.ext = e.ext)
UNION ALL SELECT pkg, 'missing_media_default', e.ext FROM k, (VALUES ('png'), ('jpg')) e(ext) WHERE EXISTS (SELECT 1 FROM p WHERE p.pkg = k.pkg AND ends_with(p.part, '.' || e.ext)) AND NOT EXISTS (SELECT 1 FROM d WHERE d.pkg = k.pkg AND d.ext = e.ext)
UNION ALL SELECT DISTINCT pkg, CASE WHEN part IN (SELECT part FROM r) THEN 'zero_byte_required_part' WHEN part = 'ppt/slides/slide1.xml' THEN 'zero_byte_slide' ELSE 'zero_byte_media' END, part FROM p WHERE bytes = 0
UNION ALL SELECT pkg, 'duplicate_entry', part FROM p GROUP BY pkg, part HAVING count(*) > 1""")
def _(t):
    part = F.when(c("l_suppkey") % 29 == 0, "_rels/.rels").otherwise(lookup(c("l_linenumber").cast("string"), ENTRIES))
    parts = t.lineitem.select(c("l_orderkey").alias("pkg"), part.alias("part"), (c("l_partkey") % 10 * 100).alias("bytes"))
    kept = F.array_compact(F.array(*[F.when(c("o_custkey") % m != 0, F.lit(e)) for e, m in (("xml", 3), ("rels", 4), ("png", 5), ("jpg", 2))]))
    return pr.package_structure(parts, t.orders.select(c("o_orderkey").alias("pkg"), F.explode(kept).alias("ext")))
