"""Structure of zip packages: XML that parses, required parts, sizes, content type defaults.

Markup is cut into tokens by one pattern and balanced by a fold that keeps the open
elements as one text, so a part is checked inside a projection, whatever the size of the
package; nothing is moved. As a parser does, a part reports its first error with the
code point at which it stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab

c = F.col

_NAME = r"[A-Za-z_:\u0080-\uFFFF][\w:.\-\u0080-\uFFFF]*+"
_REFERENCE = "&(?:#[0-9]++|#x[0-9A-Fa-f]++|amp|lt|gt|quot|apos);"
_VALUE = rf"""(?:"(?:[^<&"]++|{_REFERENCE})*+"|'(?:[^<&']++|{_REFERENCE})*+')"""
#: Comments, sections, instructions, tags, references and plain text; a lone ``<`` or ``&`` is a fault.
TOKEN = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^<>\[]*+(?:\[.*?\]\s*+)?>|</{_NAME}\s*+>|<{_NAME}(?:\s++{_NAME}\s*+=\s*+{_VALUE})*+\s*+/?>|{_REFERENCE}|[^<&]++|<|&"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _fault(rule: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _unbound(token: Column, declared: Column) -> Column:
    """Prefixes that a tag uses and neither it nor an open element declares."""
    used = F.concat(F.regexp_extract_all(token, F.lit(r"^</?([^\s:/>]+):"), 1), F.regexp_extract_all(token, F.lit(r"""\s([^\s:=<>"'/]+):[^\s:=]+\s*=\s*["']"""), 1))
    return F.filter(used, lambda p: ~p.isin("xml", "xmlns") & ~F.contains(declared, F.concat(F.lit(","), p, F.lit(","))))


def _step(acc: Column, token: Column) -> Column:
    """One token: ``open`` holds the names of the open elements, ``scope`` the prefixes that each declares."""
    opened, scope, roots = acc["open"], acc["scope"], acc["roots"]
    top = F.substring_index(opened, "/", -1)
    name = F.regexp_extract(token, r"^</?([^\s/>]+)", 1)
    own = F.array_join(F.regexp_extract_all(token, F.lit(r"""\sxmlns:([^\s=]+)\s*="""), 1), ",")
    attributes = F.regexp_extract_all(token, F.lit(r"""\s([^\s=<>"'/]+)\s*=\s*(?:"[^"]*"|'[^']*')"""), 1)
    outside, closing, alone = opened == "", token.startswith("</"), token.endswith("/>")
    markup = token.startswith("<") & ~token.startswith("<!") & ~token.startswith("<?")
    start, plain = markup & ~closing & (F.length(token) > 1), ~token.startswith("<")
    missing = _unbound(token, F.concat(scope, F.lit("/,"), own, F.lit(",")))
    white = F.regexp_replace(token, r"^\uFEFF", "").rlike(r"^[ \t\r\n]*$")
    fault = (
        F.when((token == "<") | (token == "&"), _fault("invalid_token", token))
        .when(closing & outside, _fault("stray_end_tag", name))
        .when(closing & (top != name), _fault("mismatched_tag", F.concat(top, F.lit(" closed by "), name)))
        .when(start & outside & (roots > 0), _fault("second_root", name))
        .when(start & (F.size(F.array_distinct(attributes)) < F.size(attributes)), _fault("duplicate_attribute", name))
        .when(start & (F.size(missing) > 0), _fault("unbound_prefix", F.get(missing, 0)))
        .when(outside & (plain & ~white | token.startswith("<![CDATA[")), _fault("text_outside_root"))
    )
    pushes, pops = start & ~alone, closing

    def after(value: Column, added: Column) -> Column:
        held = F.length(value) - F.length(F.substring_index(value, "/", -1)) - 1
        return F.when(pushes, F.concat(value, F.lit("/"), added)).when(pops & ~outside, value.substr(F.lit(1), held)).otherwise(value)

    done = acc["fault"].isNotNull()
    return F.struct(
        F.when(done, opened).otherwise(after(opened, name)).alias("open"),
        F.when(done, scope).otherwise(after(scope, F.concat(F.lit(","), own, F.lit(",")))).alias("scope"),
        (roots + F.when(~done & start & outside, 1).otherwise(0)).alias("roots"),
        F.when(done | fault.isNotNull(), acc["at"]).otherwise(acc["at"] + F.char_length(token)).alias("at"),
        F.coalesce(acc["fault"], fault).alias("fault"),
    )


def xml_errors(parts: DataFrame, keys=("pkg", "part"), content: str = "content") -> DataFrame:
    """``keys, rule, offset, detail``: why an XML part (bytes or text) cannot be read; no row for a sound part.

    Bytes that are not UTF-8 and control characters come first and are reported beside the first error of the markup.
    A null part has no content and is ``empty``.
    """
    raw = parts.select(*keys, c(content).cast("string").alias("t"))
    empty = raw.where(F.coalesce(F.octet_length("t"), F.lit(0)) == 0).select(*keys, F.lit("empty").alias("rule"), F.lit(0).cast("long").alias("offset"), F.lit("").alias("detail"))
    held = raw.where(F.octet_length("t") > 0)
    good = F.is_valid_utf8("t")
    broken = held.where(~good).select(*keys, F.lit("not_utf8").alias("rule"), F.char_length(F.regexp_extract(F.make_valid_utf8("t"), "(?s)^([^\uFFFD]*)", 1)).cast("long").alias("offset"), F.lit("").alias("detail"))
    sound = held.where(good)
    control = sound.where(c("t").rlike(CONTROL)).select(
        *keys, F.lit("control_character").alias("rule"), F.char_length(F.regexp_extract("t", f"(?s)^([^{CONTROL[1:-1]}]*)", 1)).cast("long").alias("offset"),
        F.format_string("U+%04X", F.ascii(F.regexp_extract("t", f"({CONTROL})", 1))).alias("detail"))
    start = F.struct(F.lit("").alias("open"), F.lit("").alias("scope"), F.lit(0).alias("roots"), F.lit(0).alias("at"), F.lit(None).cast("struct<rule:string,detail:string>").alias("fault"))
    whole = F.aggregate(F.regexp_extract_all("t", F.lit(TOKEN), 0), start, _step)
    end = F.when(c("f.roots") == 0, _fault("no_element")).when(c("f.open") != "", _fault("unclosed_tag", F.substring_index("f.open", "/", -1)))
    folded = sound.select(*keys, whole.alias("f")).select(*keys, F.coalesce(c("f.fault"), end).alias("e"), c("f.at").cast("long").alias("offset")).where("e is not null")
    markup = folded.select(*keys, c("e.rule").alias("rule"), "offset", c("e.detail").alias("detail"))
    return reduce(DataFrame.unionByName, [empty, broken, control, markup])


def numeric_tokens(parts: DataFrame, keys=("pkg", "part"), content: str = "content") -> DataFrame:
    """``keys, rule, detail, n``: words for numbers that are none, anywhere in a slide's text, and null where a number belongs."""
    words = F.transform(F.regexp_extract_all(content, F.lit(vocab.NOT_A_NUMBER), 0), lambda w: F.lower(w))
    nulls = F.transform(F.regexp_extract_all(content, F.lit(vocab.NULL_FOR_NUMBER), 1), lambda w: F.lower(w))
    found = F.concat(F.transform(words, lambda w: F.struct(F.lit("invalid_token").alias("rule"), w.alias("detail"))), F.transform(nulls, lambda w: F.struct(F.lit("null_in_number").alias("rule"), w.alias("detail"))))
    return parts.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*").groupBy(*keys, "rule", "detail").agg(F.count("*").alias("n"))


def package_structure(parts: DataFrame, defaults: DataFrame) -> DataFrame:
    """``pkg, rule, detail``: what a package lacks, from ``pkg, part, bytes`` (a row per entry) and ``pkg, ext`` defaults.

    Required parts, slides, defaults and media are flags of one aggregate per package; only
    entries that occur twice or are empty are rows of their own. A null size is not zero.
    """
    entries = parts.where(~c("part").endswith("/"))
    slide, media = c("part").rlike(r"^ppt/slides/slide\d+\.xml$"), c("part").startswith("ppt/media/")
    xml = c("part").rlike(r"\.(?:xml|rels)$")
    ext = F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1))
    flags = {f"has_{i}": F.max(c("part") == p) for i, p in enumerate(vocab.REQUIRED_PARTS)}
    flags |= {f"uses_{e}": F.max(ext == e) for e in vocab.MEDIA_DEFAULTS}
    seen = parts.groupBy("pkg").agg(F.max(slide).alias("slides"), *[v.alias(k) for k, v in flags.items()])
    declared = defaults.groupBy("pkg").agg(*[F.max(F.lower("ext") == e).alias(f"default_{e}") for e in (*vocab.REQUIRED_DEFAULTS, *vocab.MEDIA_DEFAULTS)])
    no = lambda name: ~F.coalesce(c(name), F.lit(False))
    rule = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("rule"), F.lit(detail).alias("detail")))
    lacks = [rule(no(f"has_{i}"), "missing_required_part", p) for i, p in enumerate(vocab.REQUIRED_PARTS)]
    lacks += [rule(no("slides"), "no_slide_parts", "")]
    lacks += [rule(no(f"default_{e}"), "missing_default", e) for e in vocab.REQUIRED_DEFAULTS]
    lacks += [rule(~no(f"uses_{e}") & no(f"default_{e}"), "missing_media_default", e) for e in vocab.MEDIA_DEFAULTS]
    whole = seen.join(declared, "pkg", "left").select("pkg", F.explode(F.array_compact(F.array(*lacks))).alias("r")).select("pkg", "r.*")
    kind = F.when(c("part").isin(*vocab.REQUIRED_PARTS), "zero_byte_required_part").when(slide, "zero_byte_slide").when(xml, "zero_byte_xml").when(media, "zero_byte_media")
    empty = entries.where(c("bytes") == 0).select("pkg", kind.alias("rule"), c("part").alias("detail")).where("rule is not null").distinct()
    twice = parts.groupBy("pkg", "part").agg(F.count("*").alias("n")).where("n > 1").select("pkg", F.lit("duplicate_entry").alias("rule"), c("part").alias("detail"))
    return whole.unionByName(empty).unionByName(twice)
