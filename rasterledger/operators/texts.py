"""Text, JSON and parameter-string operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.colors import darken, lighten, mix, pick, solid_over
from ..functions.columns import blank, contains_any, number

c = F.col
TOKEN = r"^\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?$"
WIDE, BLOCK = 1 << 22, 4096


def token_range(p: Column) -> Column:
    """``low, high`` of ``n`` or ``n-m``; null when the token is malformed, zero, reversed or beyond BIGINT."""
    first, last = F.regexp_extract(p, TOKEN, 1), F.regexp_extract(p, TOKEN, 2)
    low = first.try_cast("bigint")
    high = F.when(last == "", low).otherwise(last.try_cast("bigint"))
    return F.when(p.rlike(TOKEN) & (low > 0) & (high >= low), F.struct(low.alias("low"), high.alias("high")))


def range_tokens(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def range_ids(text: Column) -> Column:
    """Slide ids of ``"1-3,8"`` in input order, repeats dropped; null when a token is bad."""
    ids = F.transform(range_tokens(text), lambda p: F.get(F.transform(F.array(token_range(p)), lambda r: F.sequence(r["low"], r["high"])), 0))
    return F.array_distinct(F.flatten(ids))  # one null token makes all null


def range_pieces(ranges: Column, keep_order: bool) -> Column:
    """Disjoint ``low, high, before``: each id once, in input or in rising order, ``before`` ids ahead of the piece.

    The ends of all ranges cut the ids into pieces that lie wholly inside or outside
    every range, so only ends are held, never ids.
    """
    numbered = F.transform(ranges, lambda r, i: F.struct(i.alias("t"), r["low"].alias("low"), r["high"].alias("high")))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.array(r["low"], r["high"] + 1)))))
    spans = F.filter(F.transform(cuts, lambda low, i: F.struct(low.alias("low"), (F.get(cuts, i + 1) - 1).alias("high"))), lambda s: s["high"].isNotNull())
    owned = F.transform(spans, lambda s: F.struct(F.array_min(F.transform(F.filter(numbered, lambda r: (r["low"] <= s["low"]) & (r["high"] >= s["high"])), lambda r: r["t"])).alias("t"), s["low"].alias("low"), s["high"].alias("high")))
    held = F.filter(owned, lambda p: p["t"].isNotNull())
    ordered = F.array_sort(held) if keep_order else held
    none = F.array().cast("array<struct<low:bigint,high:bigint,before:bigint>>")
    total = lambda done: F.when(F.size(done) > 0, F.element_at(done, -1)["before"] + F.element_at(done, -1)["high"] - F.element_at(done, -1)["low"] + 1).otherwise(0)
    return F.aggregate(ordered, none, lambda done, p: F.concat(done, F.array(F.struct(p["low"].alias("low"), p["high"].alias("high"), total(done).cast("bigint").alias("before")))))


def written_out(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, place, slide``: every id of the pieces ``_p``, block by block, so that no list of ids is longer than a block."""
    wide = pieces.select(*keep, "_p", F.explode(F.sequence(c("_p.low"), c("_p.high"), F.lit(WIDE).cast("bigint"))).alias("_w"))
    blocks = wide.select(*keep, "_p", F.explode(F.sequence(c("_w"), F.least(c("_w") + WIDE - 1, c("_p.high")), F.lit(BLOCK).cast("bigint"))).alias("_b"), "_w")
    # an exchange deals one wide range out to all tasks; without it a task would hold all ids of a row at once
    # (shorter ones mostly start at the same few ids, which alone would gather all rows in a few tasks, so their rows count too)
    named = [f.name for f in blocks.schema if f.name in keep and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    short = c("_p.high") - c("_p.low") < WIDE
    blocks = blocks.repartition(*[F.when(short, c(n)) for n in named], "_b", "_w")
    ids = blocks.select(*keep, "_p", F.explode(F.sequence(c("_b"), F.least(c("_b") + BLOCK - 1, c("_w") + WIDE - 1, c("_p.high")))).alias("slide"))
    return ids.select(*keep, (c("_p.before") + c("slide") - c("_p.low")).alias("place"), "slide")


def parse_ranges(df: DataFrame, column: str, keep_order: bool = False) -> DataFrame:
    """One row per slide id with its place; one row with ``error`` and ``reason`` for a bad text.

    Ranges stay pairs of ends until the last step, which writes them out in blocks.
    """
    keep = [n for n in df.columns if n != column]
    ranges = F.transform(range_tokens(c(column)), token_range)
    rows = df.withColumn("_ranges", ranges)
    bad = F.exists("_ranges", lambda r: r.isNull()) | c("_ranges").isNull()
    digits = F.forall(range_tokens(c(column)), lambda p: p.rlike(TOKEN))
    large = digits & F.exists(range_tokens(c(column)), lambda p: F.regexp_extract(p, TOKEN, 1).try_cast("bigint").isNull() | (F.nullif(F.regexp_extract(p, TOKEN, 2), F.lit("")).isNotNull() & F.regexp_extract(p, TOKEN, 2).try_cast("bigint").isNull()))
    pieces = rows.where(~bad).select(*keep, F.explode(range_pieces(c("_ranges"), keep_order)).alias("_p"))
    good = written_out(pieces, keep).select(*keep, "place", "slide", F.lit(False).alias("error"), F.lit(None).cast("string").alias("reason"))
    reason = F.when(c(column).isNull(), "missing").when(large, "number too large").otherwise("malformed")
    flagged = rows.where(bad).select(*keep, F.lit(None).cast("bigint").alias("place"), F.lit(None).cast("bigint").alias("slide"), F.lit(True).alias("error"), reason.alias("reason"))
    return good.unionByName(flagged)


def resolve_palette(profiles: DataFrame) -> DataFrame:
    """Deck palette of each profile: first usable candidate per role, else the default."""
    d = vocab.PALETTE

    def role(name, *cands):
        return F.coalesce(pick(*[c(x) for x in cands]), F.lit(d[name]))

    rows = profiles.select(
        "id", "dark", role("bg", "bg").alias("bg"), role("line", "panelBorder").alias("line"), role("white", "ink").alias("white"),
        role("gold", "gold", "orange", "warnColor").alias("gold"), role("cyan", "info", "teal", "blue").alias("cyan"),
        role("red", "danger", "dangerColor").alias("red"), role("badge", "badgeColor", "info", "navy", "blue").alias("badge"),
        role("sub", "inkMuted").alias("sub"), role("green", "ok").alias("green"), role("orange", "orange", "gold").alias("orange"),
        role("steel", "blue", "info", "inkMuted").alias("steel"), role("badgeRed", "warnBadge", "danger").alias("badgeRed"),
        role("chevOn", "stepNumberColor", "badgeColor", "info").alias("chevOn"), role("line", "panelBorder").alias("chevLine"),
        pick(c("eyebrowColor")).alias("_eyebrow"), F.coalesce("panelFill", F.lit("#" + d["panel"])).alias("_fill"))
    rows = rows.withColumn("panel", F.coalesce(solid_over(c("_fill"), c("bg")), F.lit(d["panel"]))).drop("_fill")
    dark = c("dark")
    return rows.select(
        "*", F.when(dark, lighten(c("panel"), 0.06)).otherwise(darken(c("panel"), 0.04)).alias("panelHi"),
        lighten(c("line"), 0.12).alias("lineHi"), darken(c("gold"), 0.14).alias("goldDim"),
        F.when(dark, mix(c("bg"), c("panel"), 0.55)).otherwise(mix(c("bg"), c("line"), 0.10)).alias("chevOff"),
        F.coalesce("_eyebrow", mix(c("white"), c("cyan"), 0.35)).alias("eyebrow"),
        F.when(dark, darken(c("cyan"), 0.55)).otherwise(lighten(c("cyan"), 0.85)).alias("leadFill"),
        F.when(dark, darken(c("gold"), 0.70)).otherwise(lighten(c("gold"), 0.82)).alias("chevGoldFill"),
        F.when(dark, darken(c("red"), 0.74)).otherwise(lighten(c("red"), 0.86)).alias("chevDangerFill"),
        F.when(dark, mix(c("white"), c("cyan"), 0.15)).otherwise(c("white")).alias("chevTextOn"),
        F.when(dark, darken(c("badge"), 0.55)).otherwise(lighten(c("badge"), 0.85)).alias("tagFill"),
        F.when(dark, darken(c("gold"), 0.78)).otherwise(lighten(c("gold"), 0.86)).alias("bannerFill"),
        F.when(dark, mix(c("bg"), c("line"), 0.5)).otherwise(c("line")).alias("rline")).drop("dark", "_eyebrow")


def strip_comments(text: Column) -> Column:
    no_blocks = F.regexp_replace(text, vocab.BLOCK_COMMENT, "")
    return F.regexp_replace(no_blocks, vocab.LINE_COMMENT, "$1")


def scan_rules(files: DataFrame, patterns=vocab.FORBIDDEN_PATTERNS, tokens=vocab.BACKEND_TOKENS) -> DataFrame:
    """One row per (file, rule) hit, comments removed. Rules are constants, so the
    text is read once and nothing is joined. Fragments take ``vocab.FRAGMENT_PATTERNS`` and no tokens."""
    def hits(text, low):
        found = [F.when(text.rlike(p), F.lit(name)) for name, p in patterns]
        return F.array(*found, *[F.when(F.contains(low, F.lit(t.lower())), F.lit("token " + t)) for t in tokens])

    # bound as lambda arguments, the cleaned texts are computed once per file
    found = F.transform(F.array(strip_comments(c("text"))), lambda t: F.get(F.transform(F.array(F.lower(t)), lambda low: hits(t, low)), 0))
    return files.select("file", F.explode(F.array_compact(F.get(found, 0))).alias("rule"))


def lint_fix_text(issues: DataFrame) -> DataFrame:
    """Repair advice that weakens a gate, asks a full-slide crop or edits the product."""
    t = F.lower(F.concat_ws(" ", F.coalesce("recommended_fix", F.lit("")), F.coalesce("target_file", F.lit(""))))
    denied = contains_any(t, ["without weakening", "do not weaken", "not weaken"])
    rules = F.array(
        F.when(F.contains(t, F.lit("weaken")) & F.contains(t, F.lit("gate")) & ~denied, "weakens_gate"),
        F.when(contains_any(t, ["full-slide crop", "full slide crop"]), "full_slide_crop"),
        F.when(contains_any(t, ["save through powerpoint", "direct pptx"]), "direct_edit"))
    return issues.select("slide", "id", F.explode(F.array_compact(rules)).alias("rule"))


def canonical_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def canonical_hash(df: DataFrame, columns: list[str], out: str = "fingerprint") -> DataFrame:
    """SHA-256 of the key-sorted JSON of a row."""
    return df.withColumn(out, F.sha2(canonical_json(columns), 256))


def shortest_number(value: Column) -> Column:
    """A JSON number as the shortest text of its double: plain from 1e-6 to below 1e21, else with an exponent; -0 is 0.

    The digits are those the JVM writes; before version 19 it gives a few numbers, subnormal ones above all, a digit more.
    """
    double = value.try_cast("double")
    text = F.upper(F.abs(double).cast("string"))
    mantissa, exponent = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    whole, rest = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    joined = F.concat(whole, rest)
    led = F.regexp_replace(joined, "^0+", "")
    # the value is 0.digits times ten to the power of ``point``
    point = F.length(whole) + F.coalesce(exponent, F.lit(0)) - (F.length(joined) - F.length(led))
    digits = F.regexp_replace(led, "0+$", "")
    n = F.length(digits)
    zeros = lambda k: F.repeat(F.lit("0"), k)
    e = point - 1
    power = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string"))
    form = (F.when(digits == "", "0")
            .when((n <= point) & (point <= 21), F.concat(digits, zeros(point - n)))
            .when((point > 0) & (point <= 21), F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
            .when(n == 1, F.concat(digits, power))
            .otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."), digits.substr(F.lit(2), n), power)))
    return F.when((double < 0) & (digits != ""), F.concat(F.lit("-"), form)).otherwise(form)


def canonical_document(text: Column) -> Column:
    """The one form of a JSON document of any depth: keys sorted by UTF-16 units, lists in order, no white space.

    Numbers are doubles in their shortest text, control characters lower-case escapes, all else stands for
    itself. Text that is no JSON, or that repeats a key in one object, has no form (null).
    """
    tokens = F.regexp_extract_all(F.to_json(F.try_parse_json(text)), F.lit(r'"(?:[^"\\]++|\\.)*+"|[-0-9][-+.0-9eE]*+|[^"0-9-]++'), 0)

    def one(token: Column) -> Column:
        lowered = token
        for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):
            lowered = F.regexp_replace(lowered, r"(?<!\\)((?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
        string = F.when(token.rlike(r"\\u00[01][A-F]"), lowered).otherwise(token)
        return F.when(token.startswith('"'), string).when(token.rlike("^[-0-9]"), shortest_number(token)).otherwise(token)

    return F.array_join(F.transform(tokens, one), "")


def document_hash(df: DataFrame, column: str, out: str = "fingerprint") -> DataFrame:
    """SHA-256 of the canonical form of a JSON text; equal for documents that differ in key order, spacing or number text only."""
    return df.withColumn(out, F.sha2(canonical_document(c(column)), 256))


def nested_hash(df: DataFrame, columns: list[str], out: str = "fingerprint") -> DataFrame:
    """The same of columns of any type (structs, maps, arrays) as one document; null fields count."""
    return df.withColumn(out, F.sha2(canonical_document(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), 256))


def _text_leaves(node, wanted):
    """(key, text) pairs in document order; list items answer to their list's key."""
    stack = [("", node)]
    while stack:
        key, value = stack.pop()
        if isinstance(value, str):
            if key.lower() in wanted:
                yield key, value
        elif isinstance(value, dict):
            stack.extend((str(k), v) for k, v in reversed(list(value.items())))
        elif isinstance(value, list):
            stack.extend((key, v) for v in reversed(value))


def collect_texts(docs: DataFrame, column: str = "doc", key: str = "slide") -> DataFrame:
    """String values under the known text keys, at any depth, in document order.

    JSON objects keep the order of their keys only in the text itself, so each
    document is walked on its own inside an Arrow batch.
    """
    wanted = set(vocab.TEXT_KEYS)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for slide, text in batch.itertuples(index=False, name=None):
                try:
                    node = json.loads(text)
                except (TypeError, ValueError):
                    continue
                out += [(slide, i, k, v) for i, (k, v) in enumerate(_text_leaves(node, wanted))]
            yield pd.DataFrame(out, columns=["slide", "place", "key", "value"])

    return docs.select(key, column).mapInPandas(walk, "slide bigint, place bigint, key string, value string")


TRACE_PATHS = ["selectedSlides", "sourceSlides", "requestedSlides", "slides", "build.slides", "pipeline.slides",
               "pipeline.selectedSlides", "render.slides", "trace.slides"]
TRACE_IDS = ["sourceSlide", "sourceSlideId", "source", "slide", "slideId", "id"]
TRACE_KEYS = ["selectedslides", "source_slides", "sourceslides", "requestedslides", "requested_slides", "slides"]


def _positive(v: Column) -> Column:
    n = number(v)
    return F.when(n >= 1, F.floor(n))


def trace_value(raw: Column) -> Column:
    """``ranges, single`` of one trace value: range text, number, list of ids or list of objects; null when it is bad. Repeats of single ids stay."""
    # neither reading is tried on the other's texts: one that fails costs far more than one that works
    is_list = F.trim(raw).startswith("[")
    items = F.when(is_list, F.from_json(raw, "array<string>"))
    objects = F.exists(items, lambda i: i.startswith("{"))
    from_objects = F.array_compact(F.transform(F.filter(items, lambda i: i.startswith("{")), lambda i: F.coalesce(
        *[_positive(F.get_json_object(i, "$." + k)) for k in TRACE_IDS])))
    plain = F.transform(items, _positive)
    from_plain = F.when(F.forall(plain, lambda v: v.isNotNull()), plain)
    listed = F.transform(F.when(objects, from_objects).otherwise(from_plain), lambda v: F.struct(v.alias("low"), v.alias("high")))
    ranges = F.transform(range_tokens(F.when(~is_list, raw)), token_range)
    sound = F.when(F.forall(ranges, lambda r: r.isNotNull()), ranges)
    found = F.when(is_list, listed).otherwise(sound)
    return F.struct(found.alias("ranges"), is_list.alias("single"))


MOST_ID = (1 << 63) - 1


def _deep_trace(node) -> tuple[list[tuple[int, int]], bool]:
    """Ranges of the first slide list under a preferred key at any depth, and whether they are single ids whose repeats stay."""
    def ranges(value):
        if isinstance(value, bool) or value is None or isinstance(value, dict):
            return []
        if isinstance(value, (int, float)):
            return [(int(value), int(value))] if 1 <= value <= MOST_ID else []
        if isinstance(value, str):
            out = []
            for part in filter(None, (p.strip() for p in value.split(","))):
                lo, dash, hi = (x.strip() for x in part.partition("-"))
                if not lo.isdigit() or (dash and not hi.isdigit()):
                    return []
                a, b = int(lo), int(hi or lo)
                if not 0 < a <= b <= MOST_ID:
                    return []
                out.append((a, b))
            return out
        if any(isinstance(v, dict) for v in value):
            picked = [next((one(v[k]) for k in TRACE_IDS if k in v and one(v[k])), None) for v in value if isinstance(v, dict)]
            return [(p, p) for p in picked if p]
        found = [one(v) for v in value]
        return [(f, f) for f in found] if all(found) else []

    def one(value):
        """The id of a value that stands for a single one."""
        held = set(ranges(value))
        return next(iter(held))[0] if len(held) == 1 and all(a == b for a, b in held) else None

    if isinstance(node, dict):
        for k, v in node.items():
            if k.lower() in TRACE_KEYS and ranges(v):
                return ranges(v), not isinstance(v, str)
    if isinstance(node, list) and ranges(node):
        return ranges(node), True
    for v in node.values() if isinstance(node, dict) else node if isinstance(node, list) else []:
        found = _deep_trace(v)
        if found[0]:
            return found
    return [], False


def trace_slides(traces: DataFrame, column: str = "trace") -> DataFrame:
    """Slides named by a run trace: nine known paths first, then any preferred key.

    The known paths are read by built-in JSON functions; only documents without a
    hit go through Python. Both give ranges; ids are written out in blocks at the end. Numbers
    beyond BIGINT name no slide.
    """
    parsed = traces.select("id", column, F.try_parse_json(c(column)).alias("_v"))  # one parse for all paths
    raws = F.array_compact(F.array(*[F.try_variant_get("_v", "$." + p, "string") for p in TRACE_PATHS]))
    direct = F.get(F.filter(F.transform(raws, lambda r: trace_value(r)), lambda v: F.coalesce(F.size(v["ranges"]), F.lit(0)) > 0), 0)
    # a list of one is a fence: without it every use below would read the document again
    rows = parsed.select("id", column, F.explode(F.array(direct)).alias("found"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text in batch.itertuples(index=False, name=None):
                try:
                    node = json.loads(text)
                except (TypeError, ValueError):
                    continue
                found, single = _deep_trace(node)
                if found:
                    out.append((key, [{"low": a, "high": b} for a, b in found], single))
            yield pd.DataFrame(out, columns=["id", "ranges", "single"])

    deep = rows.where("found IS NULL").select("id", column).mapInPandas(walk, "id bigint, ranges array<struct<low:bigint,high:bigint>>, single boolean")
    every = rows.where("found IS NOT NULL").select("id", "found.ranges", "found.single").unionByName(deep)
    # one range or single ids need no cutting
    alone = F.transform("ranges", lambda r, i: F.struct(r["low"].alias("low"), r["high"].alias("high"), i.cast("bigint").alias("before")))
    cut = F.when(c("single") | (F.size("ranges") == 1), alone).otherwise(range_pieces(c("ranges"), True))
    pieces = every.select("id", F.explode(cut).alias("_p"))
    return written_out(pieces, ["id"])


def has_exception(exceptions: Column, *needles: Column, pattern: str | None = None) -> Column:
    """Does any exception entry's JSON text mention a needle (or match a pattern with a reason)?"""
    def test(e):
        text = F.lower(F.to_json(e))
        if pattern is not None:
            return text.rlike("(?i)" + pattern) & text.rlike("(?i)reason")
        out = F.contains(text, F.lower(F.coalesce(needles[0], F.lit(""))))
        for n in needles[1:]:
            out = out | F.contains(text, F.lower(F.coalesce(n, F.lit(""))))
        return out
    return F.coalesce(F.exists(exceptions, test), F.lit(False))


def textual_crop_excused(crops: DataFrame) -> DataFrame:
    """A textual crop needs a large-crop flag or reason, and an exception naming it."""
    allowed = F.coalesce("allow_large_crop", F.lit(False)) | ~blank(c("reason"))
    return crops.withColumn("excused", allowed & has_exception(c("exceptions"), c("name"), c("content_type")))
