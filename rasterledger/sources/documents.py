"""JSON evidence documents and crop plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab
from ..functions.columns import bankers

c = F.col
CORRUPT = "_corrupt"
#: What is read of a crop that is an object, aliases among it.
CROP_FIELDS = {"name": "string", "slide": "string", **dict.fromkeys("xywh", "double"), **dict.fromkeys((
    "feather_edges", "edges", "feather", "content_type", "contentType", "reconstruction_reason", "reconstructionReason", "editable_replacement",
    "editableReplacement", "allow_large_crop", "allowLargeCrop", "reason", "justification"), "string")}


def read_evidence(spark: SparkSession, glob: str, ddl: str) -> DataFrame:
    """One row per JSON file; an unreadable file is a flagged row of nulls."""
    schema = T.StructType.fromDDL(f"{ddl}, {CORRUPT} STRING")
    rows = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(glob))
    return rows.withColumns({"path": F.input_file_name(), "readable": c(CORRUPT).isNull()}).drop(CORRUPT)


def parse_evidence(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """The same for documents held in a string column."""
    schema = T.StructType.fromDDL(f"{ddl}, {CORRUPT} STRING")
    doc = F.from_json(c(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = df.withColumn("_d", doc)
    fields = [f.name for f in schema if f.name != CORRUPT]
    return rows.select("*", *[c("_d." + f).alias(f) for f in fields],
                       (c("_d").isNotNull() & c("_d." + CORRUPT).isNull()).alias("readable")).drop("_d")


def normalize_crop_plan(plans: DataFrame, column: str = "doc", fallback: str = "fallback_slide") -> DataFrame:
    """One row per crop from any of the five plan shapes.

    Shapes: ``[..]``, ``{crops: [..]}``, ``{crops: {name: ..}}``, ``{slides: {n: ..}}``
    and ``{name: [slide, x, y, w, h, edges]}`` or ``{name: {..}}``. A bad entry keeps its row,
    with ``error`` set, and so does a plan that is missing or no JSON.
    """
    keep = [n for n in plans.columns if n not in (column, fallback)]
    named = [f"_k{i}" for i in range(len(keep))]
    rows = plans.select(*[c(k).alias(n) for k, n in zip(keep, named)], F.try_parse_json(c(column)).alias("_doc"), c(fallback).cast("string").alias("_back"))
    # the document is parsed once; slides (if any) and then crops are taken from it level by level
    rows = plans.sparkSession.sql(f"""
        WITH d AS (SELECT *, try_variant_get(_doc, '$.crops', 'variant') AS _crops FROM {{rows}}),
        r AS (SELECT *, CASE WHEN _crops IS NULL THEN try_variant_get(_doc, '$.slides', 'variant') END AS _slides FROM d)
        SELECT {"".join(n + ", " for n in named)} r._back, r._doc IS NULL AS _unread, r._slides IS NOT NULL AS _by_slide, s.key AS _slide_key, e.key AS name, e.value AS value
        FROM r, LATERAL variant_explode_outer(r._slides) s, LATERAL variant_explode_outer(CASE WHEN r._slides IS NULL THEN coalesce(r._crops, r._doc) ELSE s.value END) e""", rows=rows)
    rows = rows.where(c("_unread") | c("value").isNotNull()).withColumnsRenamed(dict(zip(named, keep)))
    in_key = F.nullif(F.regexp_extract("_slide_key", r"(?i)^(?:slide)?(\d+)$", 1), F.lit(""))
    rows = rows.withColumn("_slide", F.when(c("_by_slide"), F.coalesce(in_key, "_back")).when(~c("_unread"), c("_back")))
    first = F.try_variant_get("value", "$[0]", "variant")
    listed = F.coalesce(first.isNotNull(), F.lit(False))

    # an entry is read once as an object, or once as a list of numbers and once as one of texts; a field that does not fit is null
    whole = F.try_variant_get("value", "$", f"struct<{', '.join(n + ': ' + kind for n, kind in CROP_FIELDS.items())}>")
    rows = rows.withColumn("_listed", listed).withColumns({
        "_o": F.when(~c("_listed"), whole), "_numbers": F.when(c("_listed"), F.try_variant_get("value", "$", "array<double>")),
        "_texts": F.when(c("_listed"), F.try_variant_get("value", "$", "array<string>"))})

    def at(name: str) -> Column:
        return c("_o." + name)

    def field(*names: str) -> Column:
        """First alias whose value is neither missing nor empty."""
        return F.coalesce(*[F.when(at(n) != "", at(n)) for n in names])

    def number(place: int, name: str) -> Column:
        return bankers(F.when(c("_listed"), F.get("_numbers", F.lit(place))).otherwise(at(name)))

    edges = F.upper(F.coalesce(F.when(c("_listed"), F.get("_texts", F.lit(5))).otherwise(F.coalesce(at("feather_edges"), at("edges"), at("feather"))), F.lit("")))
    slide = bankers(F.when(c("_listed"), F.get("_texts", F.lit(0))).otherwise(F.coalesce(at("slide"), c("_slide"))).try_cast("double"))
    policy = {"content_type": ("content_type", "contentType"), "reconstruction_reason": ("reconstruction_reason", "reconstructionReason"),
              "editable_replacement": ("editable_replacement", "editableReplacement")}
    default = {"content_type": "dense_infographic", "reconstruction_reason": vocab.LEGACY_REASON, "editable_replacement": "none"}
    missing = F.array_compact(F.array(*[F.when(field(*names).isNull(), F.lit(k)) for k, names in policy.items()]))
    out = rows.select(
        *keep, F.coalesce(at("name"), c("name")).alias("name"), slide.alias("slide"),
        number(1, "x").alias("x"), number(2, "y").alias("y"), number(3, "w").alias("w"), number(4, "h").alias("h"), edges.alias("feather_edges"),
        *[F.coalesce(field(*names), F.lit(default[k])).alias(k) for k, names in policy.items()],
        field("allow_large_crop", "allowLargeCrop").try_cast("boolean").alias("allow_large_crop"),
        field("reason", "justification").alias("reason"), missing.alias("missing_metadata"), "_unread")
    error = (F.when(c("_unread"), "unreadable plan").when(F.coalesce("name", F.lit("")) == "", "name missing").when(c("slide").isNull(), "slide missing")
             .when(c("x").isNull() | c("y").isNull() | c("w").isNull() | c("h").isNull(), "invalid numeric field")
             .when(~c("feather_edges").rlike("^[LRTB]*$"), "invalid feather_edges"))
    return out.withColumns({"metadata_complete": F.size("missing_metadata") == 0, "error": error}).drop("_unread")
