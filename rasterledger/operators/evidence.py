"""Evidence tables: what is missing, stale, duplicated or contradicted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import blank, lookup, round_to, whole_number
from ..functions.ranking import crowded, hot_lookup, running_number, salted_lookup

c = F.col


def expected_artifacts(slides: DataFrame, kinds: list[str]) -> DataFrame:
    """Slides x required artifact names; the names are constants, so no join."""
    return slides.select("slide", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))


def missing_artifacts(slides: DataFrame, present: DataFrame, kinds: list[str], source_kind: str | None = None) -> DataFrame:
    """Blocking issue per expected artifact that is absent. A missing source hides the rest."""
    gone = expected_artifacts(slides, kinds).join(present.select("slide", "kind"), ["slide", "kind"], "left_anti")
    if source_kind is not None:
        no_source = F.max(c("kind") == source_kind).over(W.partitionBy("slide"))
        gone = gone.withColumn("_s", no_source).where(~c("_s") | (c("kind") == source_kind)).drop("_s")
    return gone.select("slide", "kind", F.lit("missing_artifact").alias("signal"), F.lit("missing_content").alias("issue_type"), F.lit("blocking").alias("severity"))


def overlay(plan: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Plan rows with manifest values on top; rows of either side are kept."""
    p, m = plan.alias("p"), manifest.alias("m")
    fields = [f for f in plan.columns if f != key]
    return p.join(m, key, "full_outer").select(key, *[F.coalesce(c("m." + f), c("p." + f)).alias(f) for f in fields])


def reconcile(claims: DataFrame, actuals: DataFrame, excused: DataFrame, minimums: dict[str, float], tolerance: float = 0.02) -> DataFrame:
    """Claims above the count, ratios off by more than ``tolerance``, counts below a minimum."""
    both = claims.join(actuals, ["slide", "metric"], "full_outer").join(excused.select("slide", F.lit(True).alias("excused")), "slide", "left")
    claimed, actual = F.coalesce("claimed", F.lit(0.0)), F.coalesce("actual", F.lit(0.0))
    ratio = c("metric").endswith("Ratio")
    low = lookup(c("metric"), minimums)
    rules = F.array(
        F.when(~ratio & (claimed > actual), "claim_exceeds_actual"),
        F.when(ratio & (F.abs(claimed - actual) > tolerance), "ratio_disagrees"),
        F.when((actual < low) & ~F.coalesce("excused", F.lit(False)), "below_minimum"))
    return both.select("slide", "metric", claimed.alias("claimed"), actual.alias("actual"), F.explode(F.array_compact(rules)).alias("rule"))


def verify_hashes(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Recomputed SHA-256 against the recorded one; valid needs at least one check."""
    actual = files.select("path", F.sha2("content", 256).alias("actual_sha"))
    rows = expected.join(actual, "path", "left")
    return rows.groupBy("slide").agg(
        F.count("expected_sha").alias("checked"),
        F.count_if(c("actual_sha") == c("expected_sha")).alias("matched"),
        F.count_if(c("expected_sha").isNotNull() & c("actual_sha").isNull()).alias("missing")
    ).withColumn("hashes_valid", (c("checked") > 0) & (c("checked") == c("matched")) & (c("missing") == 0))


def stale_outputs(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs written before their run started (one millisecond of grace)."""
    grace = F.expr("INTERVAL 1 MILLISECOND")
    return outputs.join(runs, "run_id").where(c("mtime") + grace < c("run_start"))


def check_provenance(docs: DataFrame, images: DataFrame, strict: bool = True) -> DataFrame:
    """Recorded hash, size and units of a region file against the actual image."""
    rows = docs.join(images, "slide", "left")
    soft = "error" if strict else "warning"
    looks = c("source_hash").rlike("(?i)^[a-f0-9]{64}$")
    known = c("actual_sha").isNotNull()

    def rule(cond: Column, name: str, level: str = "error") -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level")))

    has_space = c("units").isNotNull() | c("width").isNotNull() | c("height").isNotNull()
    rules = F.array(
        rule(~c("schema_version").eqNullSafe(vocab.TEXT_REGION_SCHEMA), "unsupported_schema"),
        rule(blank(c("source_hash")), "missing_hash", soft),
        rule(~blank(c("source_hash")) & ~looks, "malformed_hash"),
        rule(~has_space, "missing_coordinate_space", soft),
        rule(has_space & F.coalesce(c("width") <= 0, F.lit(True)), "bad_width"),
        rule(has_space & F.coalesce(c("height") <= 0, F.lit(True)), "bad_height"),
        rule(has_space & ~c("units").eqNullSafe("source_px"), "bad_units"),
        rule(known & looks & (F.lower("source_hash") != F.lower("actual_sha")), "hash_mismatch"),
        rule(known & has_space & ((c("width") != c("actual_width")) | (c("height") != c("actual_height"))), "size_mismatch"))
    return rows.select("slide", F.explode(F.array_compact(rules)).alias("r")).select("slide", "r.rule", "r.level")


def crop_coverage(crops: DataFrame, width: int = vocab.CANVAS_W, height: int = vocab.CANVAS_H) -> DataFrame:
    """Area shares per slide: total, largest and by kind of content."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    area = F.when((c("w") > 0) & (c("h") > 0), c("w") * c("h")).otherwise(0)
    canvas = F.lit(float(width * height))

    def share(value):
        return F.round(value / canvas, 6)

    def only(names):
        return F.sum(F.when(kind.isin(names), area).otherwise(0))

    return crops.groupBy("slide").agg(
        F.count(F.lit(1)).alias("crops"), share(F.sum(area)).alias("total_ratio"), share(F.max(area)).alias("largest_ratio"),
        share(only(vocab.TEXTUAL_TYPES)).alias("text_ratio"), share(only(vocab.DENSE_TYPES)).alias("dense_ratio"),
        share(only(vocab.PHOTO_TYPES)).alias("photo_ratio"))


def normalize_objects(objects: DataFrame) -> DataFrame:
    """Defaults, finite numbers with three decimals, text length, icon or image."""
    def num(name):
        v = c(name)
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        away = F.signum(v) * round_to(F.abs(v), 3) + F.lit(0.0)  # halves go away from zero, and there is no minus zero
        return F.when(finite, away).otherwise(0.0).alias(name)
    kept = [n for n in objects.columns if n not in ("type", "x", "y", "w", "h", "editable", "txt", "file")]
    kind = F.coalesce("type", F.lit("shape"))
    editable = F.coalesce("editable", F.lit(True))
    if "file" in objects.columns:
        icon = F.contains(F.lower(F.replace(c("file"), F.lit("\\"), F.lit("/"))), F.lit("/icons/"))
        kind = F.when(c("file").isNotNull(), F.when(icon, "icon").otherwise("image")).otherwise(kind)
        editable = F.when(c("file").isNotNull(), icon).otherwise(editable)  # an icon is native, an image is not
    return objects.select(*kept, kind.alias("type"), *[num(n) for n in "xywh"], F.length(F.coalesce("txt", F.lit(""))).cast("bigint").alias("text_length"),
                          editable.alias("editable"))


def run_text_length(runs: Column) -> Column:
    """Length of the joined text of an array of runs ``{text, ..}``."""
    return F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(F.coalesce(r["text"], F.lit(""))))


def object_counts(objects: DataFrame) -> DataFrame:
    category = lookup(c("type"), vocab.OBJECT_CATEGORY)
    names = list(dict.fromkeys(vocab.OBJECT_CATEGORY.values()))
    return objects.groupBy("slide").agg(
        *[F.count_if(category == n).alias(n) for n in names],
        F.count_if(c("editable")).alias("editable_objects"),
        F.sum(F.when((c("type") == "text") & c("editable"), c("text_length")).otherwise(0)).alias("editable_text_length"))


def _occurrences(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with ``first`` = is it the first of its key.

    Rows move once, by their key, and the first is marked there. Where a key may hold very many rows,
    equal ones are folded to one row with a count before anything moves, the first
    row of a key is a partial aggregate, and it is brought back with salted keys;
    so neither a key with very many rows nor very many copies of one row ends in a
    single task. The copies are unfolded at the end.
    """
    full = [*order, *[n for n in rows.columns if n not in order]]
    hot = crowded(rows, keys)
    few = rows if hot is None else rows.where(~hot)
    marked = few.withColumn("first", F.row_number().over(W.partitionBy(*keys).orderBy(*full)) == 1)
    return marked if hot is None else marked.unionByName(_hot_occurrences(rows.where(hot), keys, full))


def _hot_occurrences(rows: DataFrame, keys: list[str], full: list[str]) -> DataFrame:
    folded = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    first = folded.groupBy(*keys).agg(F.min(F.struct(*full)).alias("_first"))
    marked = salted_lookup(folded, first, keys).withColumn("_lead", F.struct(*full).eqNullSafe(c("_first")))
    copies = marked.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), c("_n"))))
    return copies.withColumn("first", c("_lead") & (c("_i") == 1)).select(*rows.columns, "first")


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of a key."""
    return _occurrences(rows, keys, order).where(~c("first")).drop("first")


def merge_partitions(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """One table from per-worker tables; ``duplicate`` marks rejected repeats."""
    merged = parts[0].withColumn("worker", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        merged = merged.unionByName(p.withColumn("worker", F.lit(i)), allowMissingColumns=True)
    return _occurrences(merged, [key], ["worker", *order]).withColumn("duplicate", ~c("first")).drop("first")


def changed_keys(requested: DataFrame, cache: DataFrame, keys=("key", "sha256", "fingerprint")) -> DataFrame:
    """Requested entries whose cached hash and fingerprint no longer match."""
    return requested.select(*keys).distinct().join(cache.select(*keys), list(keys), "left_anti")


def discover_slides(listings: list[tuple[DataFrame, str]]) -> DataFrame:
    """Slide numbers found in file or folder names of several listings."""
    found = None
    for listing, pattern in listings:
        part = listing.select(F.regexp_extract("path", pattern, 1).alias("d")).select(c("d").try_cast("bigint").alias("slide")).where("slide IS NOT NULL")
        found = part if found is None else found.union(part)
    return found.distinct()


def resolve_source(slides: DataFrame, listing: DataFrame) -> DataFrame:
    """First existing of slideN, slideNN, slide-N, slide-NN."""
    n = c("slide").cast("string")
    two = F.lpad(n, F.greatest(F.length(n), F.lit(2)), F.lit("0"))
    names = [F.concat(F.lit("slide"), n), F.concat(F.lit("slide"), two), F.concat(F.lit("slide-"), n), F.concat(F.lit("slide-"), two)]
    tried = slides.select("slide", F.posexplode(F.array(*[F.concat(x, F.lit(".png")) for x in names])).alias("priority", "path"))
    found = tried.join(listing.select("path").distinct(), "path").groupBy("slide").agg(F.min_by("path", "priority").alias("path"))
    return slides.select("slide").join(found, "slide", "left")


def resolve_slide_map(requested: DataFrame, paired: DataFrame, mapped: DataFrame, trace: DataFrame, legacy: DataFrame) -> DataFrame:
    """Source, physical and html slide per deck.

    An explicit map wins over paired lists, over a plain source list, over a
    trace, over physical numbers. Inputs are long tables keyed by deck, so a deck
    of any length stays distributed; only counts per deck are compared.
    """
    def decks(df, flag):
        return df.groupBy("deck").agg(F.count(F.lit(1)).alias(flag))

    counts = decks(requested, "r")
    for df, flag in ((paired, "p"), (mapped, "m"), (trace, "t"), (legacy, "l")):
        counts = counts.join(decks(df, flag), "deck", "full_outer")
    mode = (F.when(c("m").isNotNull(), "slide-map").when(c("r").isNotNull() & c("p").isNotNull(), F.when(c("r") == c("p"), "source-physical-slides").otherwise("length-mismatch"))
            .when(c("r").isNotNull(), "source-slides-sequential").when(c("t").isNotNull(), "trace").otherwise("legacy-physical-slides"))
    modes = counts.select("deck", mode.alias("mapping_mode"), c("r").isNotNull().alias("filtered"))

    def pick(df, *names):
        return df.join(modes.where(c("mapping_mode").isin(*names)), "deck")

    def out(df, source, physical, html, error=None):
        return df.select("deck", source.alias("source_slide"), physical.alias("physical_slide"), html.alias("html_slide"), "mapping_mode",
                         (F.lit(error) if error is None or isinstance(error, str) else error).cast("string").alias("error"))

    asked = pick(requested, "slide-map").join(mapped, ["deck", "source"], "left")
    unmapped = F.when(c("physical").isNull(), F.lit("not in slide map"))
    by_map = out(asked, c("source"), c("physical"), c("html"), unmapped).unionByName(
        out(pick(mapped, "slide-map").where(~c("filtered")), c("source"), c("physical"), c("html")))
    by_pair = out(pick(requested, "source-physical-slides").join(paired, ["deck", "ord"]), c("source"), c("physical"), c("physical"))
    broken = out(pick(requested, "length-mismatch"), c("source"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "list lengths differ")
    by_seq = out(pick(requested, "source-slides-sequential"), c("source"), c("ord"), c("ord"))
    by_trace = out(pick(trace, "trace"), c("source"), c("ord"), c("ord"))
    by_legacy = out(pick(legacy, "legacy-physical-slides"), c("slide"), c("slide"), c("slide"))
    return by_map.unionByName(by_pair).unionByName(broken).unionByName(by_seq).unionByName(by_trace).unionByName(by_legacy)


def physical_numbering(sources: DataFrame) -> DataFrame:
    """Source ids of a deck in order -> physical slides 1..N."""
    return running_number(sources, ["deck"], [], "source", "physical")


def style_match(slides: DataFrame, library: DataFrame, dims: list[str]) -> DataFrame:
    """Nearest library profile by number of agreeing dimensions; of equally near ones the smallest id.

    The library is an index with a key for each subset of the dimensions and its values, and one profile
    per key, the smallest. A look asks for each of its subsets; the largest that answers wins. So nothing is joined
    on a single value as such, a key of the index is one row, and keys that many looks share are looked up in
    place (``hot_lookup``). A null agrees with nothing.
    """
    subsets = [[d for i, d in enumerate(dims) if m >> i & 1] for m in range(1, 1 << len(dims))]
    texts = {d: c(d).cast("string") for d in dims}

    def asked(df: DataFrame, keep: str) -> DataFrame:
        each = [F.when(reduce(lambda a, b: a & b, [texts[d].isNotNull() for d in s]), F.struct(F.lit(len(s)).alias("size"), F.concat(F.lit("|".join(s) + ":"), F.to_json(F.array(*[texts[d] for d in s]))).alias("key"))) for s in subsets]
        return df.select(keep, F.explode(F.array_compact(F.array(*each))).alias("e")).select(keep, "e.*")

    index = asked(library.withColumnRenamed("id", "profile"), "profile").groupBy("key").agg(F.min("profile").alias("profile"))
    look = F.to_json(F.struct(*[texts[d].alias(d) for d in dims]), {"ignoreNullFields": "false"})
    seen = slides.select("id", look.alias("look"))
    looks = slides.select(*dims).distinct().withColumn("look", look)
    found = hot_lookup(asked(looks, "look"), index, ["key"]).groupBy("look").agg(*[F.min(F.when(F.col("size") == k, F.col("profile"))).alias(f"p{k}") for k in range(len(dims), 0, -1)])
    sizes = range(len(dims), 0, -1)
    agreeing = F.coalesce(*[F.when(c(f"p{k}").isNotNull(), F.lit(k).cast("bigint")) for k in sizes])
    best = found.select("look", F.coalesce(*[c(f"p{k}") for k in sizes]).alias("profile"), agreeing.alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return hot_lookup(seen, best, ["look"]).select(
        "id", "profile", n.alias("agreeing"), F.when(n == len(dims), "high").when(n > 0, "partial").otherwise("none").alias("confidence"))


def detect_shortcuts(evidence: DataFrame) -> DataFrame:
    """Slides whose evidence names a full-slide image or a crop that covers nearly all.

    ``evidence`` is flat: ``slide, entry, key, value`` plus the entry's text.
    """
    key = F.lower("key")
    text = F.lower("text")
    number = c("value").try_cast("double")
    area = key.rlike("coverage|ratio|area")
    share = (F.when(area & number.between(0.0, 1.0), number)
             .when(area & (number > 1.0) & (number <= 100.0) & F.contains(key, F.lit("percent")), number / 100))
    per = evidence.groupBy("slide", "entry").agg(
        F.max(text.rlike("full[_ -]slide")).alias("marker"), F.max(F.contains(text, F.lit("crop"))).alias("crop"), F.max(share).alias("share"))
    found = F.when(c("marker"), "full_slide_marker").when(c("crop") & (c("share") >= 0.92), "crop_coverage")
    return per.withColumn("finding", found).where(c("finding").isNotNull()).select("slide", "entry", "finding", F.when(~c("marker"), c("share")).alias("share"))


# ---- packages ------------------------------------------------------------------

def fold_path(path: Column) -> Column:
    """``.`` and ``..`` folded; leading ``..`` stay on a relative path only."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = clean.startswith("/")
    up = F.lit("..")

    def step(acc, part):
        at_top = (acc == "") | (acc == "..") | acc.endswith("/..")
        joined = F.when(acc == "", part).otherwise(F.concat(acc, F.lit("/"), part))
        popped = F.regexp_replace(acc, "/?[^/]+$", "")
        return (F.when((part == "") | (part == "."), acc)
                .when(part == up, F.when(~at_top, popped).when(rooted, acc).otherwise(joined)).otherwise(joined))

    return F.aggregate(F.split(clean, "/"), F.lit(""), step)


def resolve_targets(links: DataFrame) -> DataFrame:
    """Target of a relationship, relative to the part that owns the rels file."""
    target = F.split_part(F.replace(F.coalesce("target", F.lit("")), F.lit("\\"), F.lit("/")), F.lit("#"), F.lit(1))
    folder = F.regexp_extract("rels_part", "^(?:(.*)/)?_rels/[^/]*$", 1)
    full = F.when(target.startswith("/"), target).when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    out = links.withColumn("resolved", F.when(target == "", F.lit("")).otherwise(fold_path(full)))
    return out.withColumn("inside", ~c("resolved").startswith(".."))


def link_integrity(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Empty or missing internal targets and repeated ids per owner."""
    inner = resolve_targets(links.where(~c("mode").eqNullSafe("External")))
    known = parts.select("pkg", c("part").alias("resolved")).distinct()
    keys = ["pkg", "rels_part", "rel_id"]
    empty = inner.where(c("resolved") == "").select(*keys, F.lit("empty_target").alias("rule"), F.lit("").alias("detail"))
    gone = inner.where(c("resolved") != "").join(known, ["pkg", "resolved"], "left_anti").select(*keys, F.lit("missing_target").alias("rule"), c("resolved").alias("detail"))
    twice = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate_id").alias("rule"), c("n").cast("string").alias("detail"))
    return empty.unionByName(gone).unionByName(twice)


def type_coverage(parts: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Parts without a declared content type, by extension or by name."""
    ext = F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1))
    used = parts.withColumn("ext", ext).where(c("ext") != "")
    open_parts = used.join(defaults.select("pkg", "ext"), ["pkg", "ext"], "left_anti").join(overrides.select("pkg", "part"), ["pkg", "part"], "left_anti")
    level = F.when(c("ext").isin("xml", "rels", "png", "jpg", "jpeg", "svg"), "error").otherwise("warning")
    return open_parts.select("pkg", "part", "ext", level.alias("level"))


def check_numeric_attrs(parts: DataFrame) -> DataFrame:
    """Coordinates and sizes that are not finite, not positive or far too large.

    Whole positive ``cx`` and ``cy`` are asked of extents (``ext``) alone, and not inside the properties of a group.
    """
    keys = ["slide", "part"]

    def named(rows: DataFrame, text: str, names: str) -> DataFrame:
        """One row per attribute: matches are cut out whole and taken apart as plain strings."""
        found = F.regexp_extract_all(text, F.lit(rf"""\s(?:{names})\s*=\s*(?:"[^"]*"|'[^']*')"""), 0)
        each = rows.select(*keys, F.explode(found).alias("_m"))
        name, after = F.substring_index("_m", "=", 1), F.expr("substring(_m, instr(_m, '=') + 1)")
        quoted = F.btrim(after, F.lit(blanks))
        raw = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        # a list of one is a fence: without it every rule would take the match apart again
        return each.select(*keys, F.btrim(name, F.lit(blanks)).alias("attr"), F.explode(F.array(raw)).alias("raw")).select(*keys, "attr", "raw", F.explode(F.array(whole_number(c("raw")))).alias("value"))

    blanks = " \t\n\x0b\f\r"  # what \s stands for
    attrs = named(parts, "text", "x|y|cx|cy|w|h")
    ungrouped = F.when(F.contains("text", F.lit("grpSpPr")), F.regexp_replace("text", r"(?s)<((?:[\w.-]+:)?grpSpPr)(?:\s[^<>]*)?(?<!/)>.*?</\1\s*>", "")).otherwise(c("text"))
    extents = parts.select(*keys, F.explode(F.regexp_extract_all(ungrouped, F.lit(r"<(?:[\w.-]+:)?ext(?=[\s/>])[^<>]*>"), 0)).alias("_tag"))
    extents = named(extents, "_tag", "cx|cy")
    value = c("value")
    wordy = value.isNull()  # a whole number holds no word

    def rules(rows: DataFrame, found: list[tuple[Column, str, str]]) -> DataFrame:
        each = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for cond, name, level in found]
        # most rows break no rule, so they are left out before any list is made
        broken = rows.where(reduce(Column.__or__, [F.coalesce(cond, F.lit(False)) for cond, _, _ in found]))
        return broken.select(*keys, "attr", "raw", F.explode(F.array_compact(F.array(*each))).alias("r")).select(*keys, "attr", "raw", "r.*")

    everywhere = rules(attrs, [
        (wordy & c("raw").rlike(vocab.NOT_A_NUMBER), "non_finite", "error"),
        (wordy & c("raw").rlike(r"(?i)\bnull\b"), "null_in_number", "error"),
        (c("attr").isin("cx", "cy", "w", "h") & (value < 0), "negative_size", "warning"),
        (F.abs(value) > vocab.EMU_EXTREME, "extremely_large", "warning")])
    sizes = rules(extents, [(value.isNull(), "not_a_whole_number", "error"), (value <= 0, "size_not_positive", "error")])
    control = parts.where(c("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")).select(
        *keys, F.lit("").alias("attr"), F.lit("").alias("raw"), F.lit("control_character").alias("rule"), F.lit("error").alias("level"))
    return everywhere.unionByName(sizes).unionByName(control)


def package_summary(parts: DataFrame, violations: DataFrame) -> DataFrame:
    counts = parts.groupBy("pkg").agg(F.count(F.lit(1)).alias("entries"), F.count_if(c("part").rlike(r"\.(xml|rels)$")).alias("parsed_parts"))
    bad = violations.groupBy("pkg").agg(F.count_if(c("level") == "error").alias("errors"), F.count_if(c("level") == "warning").alias("warnings"))
    return (counts.join(bad, "pkg", "left").fillna(0, ["errors", "warnings"]).withColumn("passed", c("errors") == 0))


def normalize_geometry(objects: DataFrame, width: int = vocab.CANVAS_W) -> DataFrame:
    """Lines with positive extent and an orientation, plus inch and point sizes."""
    def num(name):
        v = c(name)
        return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)
    x, y, w, h = (num(n) for n in "xywh")
    flat, upright = F.abs(h) < 1e-4, F.abs(w) < 1e-4
    nx, ny = F.when(w < 0, x + w).otherwise(x), F.when(h < 0, y + h).otherwise(y)
    wide, high = F.greatest(F.abs(w), F.lit(0.25)), F.greatest(F.abs(h), F.lit(0.25))
    zero = F.lit(0.0)
    inch, point = 13.333 / width, 72 * 13.333 / width
    kept = [n for n in objects.columns if n not in ("x", "y", "w", "h")]
    return objects.select(
        *kept, nx.alias("x"), ny.alias("y"),
        F.when(flat, wide).when(upright, zero).otherwise(wide).alias("w"), F.when(flat, zero).otherwise(high).alias("h"),
        F.when(flat, "horizontal").when(upright, "vertical").otherwise("diagonal").alias("orientation"),
        round_to(nx * inch, 3).alias("x_inch"), round_to(ny * inch, 3).alias("y_inch"),
        F.when(F.abs(w) == 0, 0.25).otherwise(F.abs(w)).alias("safe_w"), F.when(F.abs(h) == 0, 0.25).otherwise(F.abs(h)).alias("safe_h"),
        round_to(F.greatest(F.abs(w) * point, F.lit(0.1)), 3).alias("w_point"))
