"""Queries that classify, rank and roll up."""

from pyspark.sql import functions as F

from .. import vocab
from ..functions.stars import components
from ..operators import rollup, severity
from ..plans import visual_qa
from .pixels import METRICS_SQL_CTE, rounded
from .registry import query, sql_case, sql_list

KIND_SQL = "CASE comparison WHEN 'pptx_vs_html' THEN 'P' ELSE 'S' END"


def _band_sql(group, joiner, op_text):
    parts = {}
    for kind, code in ((vocab.SOURCE_KIND, "S"), (vocab.PAIR_KIND, "P")):
        terms = []
        for name, value in vocab.CALIBRATION[group][kind].items():
            if name[:-3] in vocab.METRIC_OF and name[-3:] in ("Max", "Min"):
                cmp = "<=" if name[-3:] == "Max" else ">="
                terms.append(op_text.format(f"{vocab.METRIC_OF[name[:-3]]} {cmp} {value}::DOUBLE"))
        parts[code] = joiner.join(terms)
    return f"CASE WHEN {KIND_SQL} = 'S' THEN {parts['S']} ELSE {parts['P']} END"


FACTS_CTE = f"""facts AS (SELECT *, {KIND_SQL} AS k,
  {_band_sql('knownBadMetricBands', ' + ', '(CASE WHEN {} THEN 1 ELSE 0 END)')} AS signal_count,
  CASE WHEN {KIND_SQL} = 'S' THEN 2 ELSE 3 END AS required,
  {_band_sql('knownGoodMetricBands', ' AND ', 'coalesce({}, false)')} AS within_good,
  {_band_sql('borderlineMetricBands', ' AND ', 'coalesce({}, false)')} AS within_borderline FROM mx)"""
CRITICAL = sql_list(vocab.CRITICAL_SIGNALS)
CLASS_CTE = f"""{FACTS_CTE},
ctx AS (SELECT slide, bool_or(c) AS pair_blocks FROM (
   SELECT slide, k = 'S' AND signal_count >= required AS c FROM facts
   UNION ALL SELECT slide, severity = 'blocking' AND type IN ({CRITICAL}) FROM sg) q GROUP BY slide),
cl AS (SELECT facts.*, CASE WHEN signal_count >= required AND k = 'P' AND NOT coalesce(pair_blocks, false) THEN 'material_mismatch_needs_review'
   WHEN signal_count >= required THEN 'known_bad_like' WHEN within_good THEN 'known_good_like' WHEN within_borderline THEN 'borderline_like' ELSE 'out_of_band' END AS classification,
   CASE WHEN signal_count >= required AND k = 'P' AND NOT coalesce(pair_blocks, false) THEN 'noticeable'
   WHEN signal_count >= required THEN 'blocking' WHEN within_good THEN 'minor' ELSE 'noticeable' END AS severity
  FROM facts LEFT JOIN ctx USING (slide))"""
SLIDE_CTE = f"""{CLASS_CTE},
rk AS (SELECT slide, CASE severity WHEN 'blocking' THEN 3 WHEN 'noticeable' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END AS r FROM cl
       UNION ALL SELECT slide, CASE severity WHEN 'blocking' THEN 3 WHEN 'noticeable' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END FROM sg),
sv AS (SELECT slide, max(r) AS r FROM rk GROUP BY slide),
cr AS (SELECT slide, bool_or(severity = 'blocking' AND type IN ({CRITICAL})) AS critical FROM sg GROUP BY slide),
gd AS (SELECT slide, bool_and(within_good) AS good FROM cl GROUP BY slide),
sl AS (SELECT sv.slide, CASE r WHEN 3 THEN 'fail' WHEN 2 THEN 'needs_polish' ELSE 'pass' END AS status,
   CASE r WHEN 3 THEN 'blocking' WHEN 2 THEN 'noticeable' WHEN 1 THEN 'minor' ELSE 'pass' END AS severity,
   CASE WHEN coalesce(critical, false) OR r = 3 THEN 0.9::DOUBLE WHEN coalesce(good, true) THEN 0.86::DOUBLE WHEN r = 2 THEN 0.78::DOUBLE ELSE 0.72::DOUBLE END AS confidence,
   r IN (1, 2) AND NOT coalesce(critical, false) AS tolerance_applied
  FROM sv LEFT JOIN cr USING (slide) LEFT JOIN gd USING (slide))"""


@query("classify_comparison", f"""WITH mx AS (SELECT * FROM fx_metrics), sg AS (SELECT * FROM fx_signals), {CLASS_CTE}
SELECT slide, comparison, signal_count::BIGINT AS signal_count, within_good, within_borderline, classification, severity FROM cl""", "fx_metrics fx_signals")
def _(t):
    return severity.classify_comparison(t.fx_metrics, t.fx_signals).select(
        "slide", "comparison", "signal_count", "within_good", "within_borderline", "classification", "severity")


@query("slide_severity", f"WITH mx AS (SELECT * FROM fx_metrics), sg AS (SELECT * FROM fx_signals), {SLIDE_CTE} SELECT * FROM sl", "fx_metrics fx_signals")
def _(t):
    return severity.slide_severity(t.fx_metrics, t.fx_signals)


@query("visual_qa", f"WITH {METRICS_SQL_CTE}, mx AS (SELECT * FROM pm JOIN em USING (slide, comparison) JOIN drift USING (slide, comparison) JOIN ssim USING (slide, comparison)), "
                    f"sg AS (SELECT * FROM fx_signals), {SLIDE_CTE} SELECT * FROM sl", "fx_surfaces fx_pairs fx_signals")
def _(t):
    return visual_qa.assess_slides(t.fx_surfaces, t.fx_signals)


FIX_SQL = """
fp AS (SELECT cl.slide, comparison, severity, coalesce(edge_difference_ratio,0) AS e, coalesce(color_palette_drift,0) >= 0.22::DOUBLE AS hp,
  coalesce(edge_difference_ratio,0) >= 0.135::DOUBLE AS he, coalesce(edge_density_delta,0) >= 0.006::DOUBLE AND coalesce(edge_difference_ratio,0) >= 0.10::DOUBLE AS lo,
  coalesce(pixel_difference_ratio,0) AS p, comparison = 'pptx_vs_html' AS pair, classification, board, stop_flow, technical_diagram, schematic
  FROM cl LEFT JOIN fx_tags USING (slide) WHERE severity IN ('blocking', 'noticeable')),
fr AS (SELECT *, CASE WHEN pair AND (e >= 0.095::DOUBLE OR e > p*0.75) THEN 1 WHEN pair THEN 2 WHEN board AND hp THEN 3 WHEN stop_flow AND (he OR lo) THEN 4
  WHEN stop_flow AND hp THEN 5 WHEN technical_diagram AND (he OR hp OR lo) THEN 6 WHEN schematic AND (he OR lo) THEN 7 WHEN lo OR he THEN 8 WHEN hp THEN 9
  WHEN classification = 'out_of_band' THEN 10 ELSE 11 END AS rule FROM fp),
fx AS (SELECT slide, comparison, severity, ['pptx_html_edge_mismatch','pptx_html_mismatch','board_texture_missing','missing_detail_density','missing_detail_density',
  'technical_diagram_under_detailed','schematic_density_low','edge_density_low','palette_drift','acceptable_native_simplification','spacing'][rule] AS type,
 ['helper_layout_parity','helper_layout_parity','native_board_structure_plus_non_text_texture','native_stop_flow_detail_density','native_stop_flow_detail_density',
  'native_technical_density_then_small_non_text_crops','native_schematic_density_then_small_non_text_crops','native_edge_density','palette_and_material_tuning',
  'inspect_editable_simplification','spacing_layout_tuning'][rule] AS fix_strategy, rule IN (3,6,7) AS crop_allowed,
 ['','','palette_drift|non_text_detail_crop_candidate','edge_density_low','palette_drift','edge_density_low|non_text_detail_crop_candidate',
  'edge_density_low|non_text_detail_crop_candidate','missing_detail_density','','',''][rule] AS secondary FROM fr)"""


@query("fix_plan", f"WITH mx AS (SELECT * FROM fx_metrics), sg AS (SELECT * FROM fx_signals), {CLASS_CTE}, {FIX_SQL} SELECT * FROM fx", "fx_metrics fx_signals fx_tags")
def _(t):
    return severity.fix_plan(severity.classify_comparison(t.fx_metrics, t.fx_signals), t.fx_tags).select(
        "slide", "comparison", "severity", "type", "fix_strategy", "crop_allowed", F.array_join("secondary_issue_types", "|").alias("secondary"))


@query("crop_policy_check", f"""WITH mx AS (SELECT * FROM fx_metrics), sg AS (SELECT * FROM fx_signals), {CLASS_CTE}, {FIX_SQL}
SELECT fx.slide, comparison, type, name, content_type, coalesce(crop_allowed AND CASE WHEN type = 'board_texture_missing'
  THEN lower(content_type) IN ('decorative','texture','3d') ELSE lower(content_type) IN ('3d','technical','decorative','texture','photo') END, false) AS allowed
FROM fx JOIN fx_crops c ON c.slide = fx.slide""", "fx_metrics fx_signals fx_tags fx_crops")
def _(t):
    plan = severity.fix_plan(severity.classify_comparison(t.fx_metrics, t.fx_signals), t.fx_tags)
    return severity.crop_policy_check(plan, t.fx_crops.select("slide", "name", "content_type")).select(
        "slide", "comparison", "type", "name", "content_type", "allowed")


@query("status_of_severity", f"""SELECT severity, CASE severity WHEN 'blocking' THEN 'fail' WHEN 'noticeable' THEN 'needs_polish' ELSE 'pass' END AS status,
  count(*) AS issues FROM fx_issues GROUP BY ALL""", "fx_issues")
def _(t):
    return t.fx_issues.groupBy("severity", severity.status_of(F.col("severity")).alias("status")).agg(F.count(F.lit(1)).alias("issues"))


def _hits(words, text="t"):
    return " + ".join(f"(contains({text}, '{w}'))::INT" for w in words)


def _any(words, text="t"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query("domain_tags", f"""
WITH v AS (SELECT doc_id AS slide, lower(array_to_string(string_split(text, chr(10)), ' ')) AS t,
   lower(array_to_string(list_slice(string_split(text, chr(10)), 1, 8), ' ')) AS h FROM documents)
SELECT slide, ({_hits(vocab.LEXICONS['technical'])})::BIGINT AS technical_hits, ({_hits(vocab.LEXICONS['schematic'])})::BIGINT AS schematic_hits,
  ({_hits(vocab.LEXICONS['board'])})::BIGINT AS board_hits, ({_hits(vocab.LEXICONS['stop'])})::BIGINT AS stop_hits,
  ({_hits(vocab.LEXICONS['stop'])}) > 0 AS stop_flow, {_any(vocab.BOARD_HEADINGS, 'h')} AS board,
  {_any(vocab.SCHEMATIC_PHRASES)} OR (({_hits(vocab.LEXICONS['schematic'])}) >= 3 AND contains(t, 'flow')) AS schematic,
  {_any(vocab.TECHNICAL_PHRASES)} OR (({_hits(vocab.LEXICONS['technical'])}) >= 4 AND NOT contains(t, '{vocab.TECHNICAL_EXCLUDED}')) AS technical_diagram FROM v""")
def _(t):
    return severity.domain_tags(t.documents.select(F.col("doc_id").alias("slide"), F.split("text", "\n").alias("values")))


@query("deck_summary", """
SELECT 'status' AS measure, status AS key, count(*) AS n FROM fx_summary GROUP BY ALL
UNION ALL SELECT 'issue_severity', severity, count(*) FROM fx_issues GROUP BY ALL
UNION ALL SELECT 'issue_type', type, count(*) FROM fx_issues GROUP BY ALL
UNION ALL SELECT 'fix_strategy', fix_strategy, count(*) FROM fx_issues WHERE fix_strategy IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'crop_recommended', 'true', count(*) FROM fx_issues WHERE crop_allowed""", "fx_summary fx_issues")
def _(t):
    return rollup.deck_summary(t.fx_summary, t.fx_issues)


@query("common_types", "SELECT type, count(*) AS n FROM fx_issues GROUP BY type", "fx_issues")
def _(t):
    return rollup.common_types(t.fx_issues)


RANK = "CASE severity WHEN 'blocking' THEN 3 WHEN 'noticeable' THEN 2 WHEN 'minor' THEN 1 ELSE 0 END"


@query("worst_slides", f"""SELECT slide, status, severity, issue_count FROM (SELECT slide, status, CASE WHEN slide % 501 = 0 THEN NULL WHEN slide % 502 = 0 THEN 'odd' ELSE severity END AS severity, issue_count FROM fx_summary) q
ORDER BY {RANK.replace("WHEN 'blocking' THEN 3 ", "").replace("ELSE 0", "WHEN 'pass' THEN 0 ELSE 3")} DESC, issue_count DESC, slide LIMIT 10""", "fx_summary")
def _(t):
    known = F.when(F.col("slide") % 501 == 0, F.lit(None)).when(F.col("slide") % 502 == 0, "odd").otherwise(F.col("severity"))
    return rollup.worst_slides(t.fx_summary.withColumn("severity", known)).select("slide", "status", "severity", "issue_count")


@query("backlog_lists", """SELECT CASE WHEN status IN ('pass', 'needs_polish') THEN status ELSE 'fail' END AS list, slide FROM fx_summary
UNION ALL SELECT 'blocking', slide FROM fx_summary WHERE status = 'fail' OR severity = 'blocking' OR blocking > 0""", "fx_summary")
def _(t):
    return rollup.backlog(t.fx_summary)


WEIGHT = sql_case("type", {x: len(vocab.ISSUE_PRIORITY) - i for i, x in enumerate(vocab.ISSUE_PRIORITY)}, "0")
SCORE_CTE = f"""ty AS (SELECT slide, type, min(event_id) AS first_seen FROM fx_issues GROUP BY ALL),
bo AS (SELECT slide, sum({WEIGHT}) AS bonus, count(*) AS type_count FROM ty GROUP BY slide),
sc AS (SELECT s.slide, status, severity, issue_count, coalesce(type_count, 0) AS type_count, (CASE status WHEN 'fail' THEN 1000 ELSE 0 END + CASE severity WHEN 'blocking' THEN 500 ELSE 0 END
   + blocking*100 + issue_count*10 + coalesce(bonus, 0))::BIGINT AS score FROM fx_summary s LEFT JOIN bo USING (slide) WHERE {{w}})"""
BLOCK = "status = 'fail' OR severity = 'blocking' OR blocking > 0"


@query("repair_score", f"WITH {SCORE_CTE.format(w='status <> ' + chr(39) + 'pass' + chr(39))} SELECT * FROM sc", "fx_issues fx_summary")
def _(t):
    return rollup.repair_score(t.fx_summary, t.fx_issues, "strict")


@query("wave_chunking", f"""WITH {SCORE_CTE.format(w='(' + BLOCK + ') OR status = ' + chr(39) + 'needs_polish' + chr(39))},
rk AS (SELECT slide, row_number() OVER (ORDER BY score DESC, slide) AS place FROM sc),
wv AS (SELECT slide, place, (place-1)//5 + 1 AS wave FROM rk),
tt AS (SELECT wave, type, min((place*1000000000) + first_seen) AS pos FROM ty JOIN wv USING (slide) GROUP BY ALL)
SELECT 'repair-wave-' || wave AS wave_id, string_agg(slide::VARCHAR, ',' ORDER BY place) AS slides,
  (SELECT string_agg(type, ',' ORDER BY pos) FROM tt WHERE tt.wave = wv.wave) AS issue_types FROM wv GROUP BY wave""", "fx_issues fx_summary")
def _(t):
    return rollup.waves(rollup.repair_score(t.fx_summary, t.fx_issues, "polish"), t.fx_issues)


@query("issue_numbering", """SELECT slide, event_id, printf('s%d_issue_%03d', slide, row_number() OVER (PARTITION BY slide ORDER BY event_id)) AS issue_id, type, severity FROM fx_issues""", "fx_issues")
def _(t):
    return rollup.number_issues(t.fx_issues).select("slide", "event_id", "issue_id", "type", "severity")


@query("strategy_lookup", f"SELECT slide, event_id, type, {sql_case('type', vocab.STRATEGIES, chr(39) + vocab.DEFAULT_STRATEGY + chr(39))} AS strategy FROM fx_issues", "fx_issues")
def _(t):
    return rollup.strategy_lookup(t.fx_issues).select("slide", "event_id", "type", "strategy")


@query("layout_box_drift", """
WITH b AS (SELECT l_orderkey AS slide, (l_suppkey % 9)*4 + (l_partkey % 5)*2 + abs(l_quantity - (l_linenumber*7)) + (l_tax*100) AS d FROM lineitem WHERE l_suppkey % 10 <> 0)
SELECT slide, count(*) AS box_count, round(avg(d), 6) AS mean_drift, round(max(d), 6) AS max_drift FROM b GROUP BY slide""")
def _(t):
    # a pair without a usable render box is skipped by the operator itself
    c = F.col
    x, y = (c("l_partkey") * 37 % 1500).cast("double"), ((c("l_suppkey") * 53 + c("l_linenumber") * 97) % 860).cast("double")
    boxes = t.lineitem.select(
        c("l_orderkey").alias("slide"), x.alias("sx"), y.alias("sy"), c("l_quantity").alias("sw"), F.lit(10.0).alias("sh"),
        F.when(c("l_suppkey") % 10 != 0, x + c("l_suppkey") % 9 * 4).alias("rx"), (y - c("l_partkey") % 5 * 2).alias("ry"),
        (c("l_linenumber") * 7).cast("double").alias("rw"), (c("l_tax") * 100 + 10).alias("rh"))
    return rounded(rollup.layout_drift(boxes), "mean_drift", "max_drift")


HISTORY = "hi AS (SELECT slide, event_id, severity, ts::DATE AS d FROM fx_issues)"


@query("iteration_convergence", f"""WITH {HISTORY},
la AS (SELECT slide, d, arg_max(severity, event_id) AS severity FROM hi GROUP BY ALL),
ch AS (SELECT d, (severity = 'blocking')::INT - coalesce(lag((severity = 'blocking')::INT) OVER (PARTITION BY slide ORDER BY d), 0) AS c FROM la),
st AS (SELECT d, sum(c) AS c FROM ch GROUP BY d),
cu AS (SELECT d, (sum(c) OVER (ORDER BY d))::BIGINT AS b, row_number() OVER (ORDER BY d) AS n FROM st)
SELECT d::VARCHAR AS iteration, n AS round, b AS blocking_slides, b = 0 OR n >= 6 AS stop FROM cu""", "fx_issues")
def _(t):
    return rollup.convergence(t.fx_issues.withColumn("iteration", F.to_date("ts").cast("string")))


@query("last_status", f"WITH {HISTORY} SELECT slide, arg_max(severity, event_id) AS severity, max(d)::VARCHAR AS iteration FROM hi GROUP BY slide", "fx_issues")
def _(t):
    return rollup.last_status(t.fx_issues.withColumn("iteration", F.to_date("ts").cast("string")))


@query("linked_components", """SELECT 1000000 + c_custkey AS node, n_regionkey AS label FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT DISTINCT CAST(n_regionkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation""")
def _(t):
    """Customers hang on nations and nations on regions: few nodes with very many links."""
    c = F.col
    up = t.customer.select((c("c_custkey") + 1000000).alias("u"), (c("c_nationkey") + 1000).alias("v"))
    links = up.unionByName(t.nation.select((c("n_nationkey") + 1000).alias("u"), c("n_regionkey").alias("v")))
    whole = links.select(F.lit(0).alias("graph"), c("u").cast("bigint").alias("u"), c("v").cast("bigint").alias("v"))
    return components(whole, ["graph"], local=0).drop("graph")
