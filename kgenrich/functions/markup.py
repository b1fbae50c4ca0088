"""Encyclopedia-markup cleaning as Column expressions (no UDF).

The steps run in the original order. Loops of the form "for every match in
the text, replace it everywhere" are ``aggregate(regexp_extract_all(...))``
over the match list, so everything stays inside the JVM. ``clean_article``
returns the clean text and the list of wikilinks seen (for E18).
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -----------------------------------------------------------
GARBAGE_TAGS = ["ref", "gallery", "timeline", "noinclude", "pre", "table", "tr", "td",
                "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir"]
WRAPPER_TAGS = ["nowiki", "cite", "source", "hiero", "div", "font", "span", "strong",
                "strike", "blockquote", "tt", "var", "sup", "sub", "big", "small",
                "center", "h1", "h2", "h3", "em", "b", "i", "u", "a", "s", "p"]
SINGLE_TAGS = ["references", "ref", "img", "br", "hr", "li", "dt", "dd"]
PLACEHOLDER_TAGS = [("math", "formula"), ("code", "codice")]
PROJECT_NAMESPACES = ["wikipedia", "mediawiki", "wikiquote", "wikibooks", "wikisource",
                      "wiktionary", "wikispecies", "wikinews", "wikiversita", "commons"]
GARBAGE_NAMESPACES = ["immagine", "image", "categoria", "category", "file"]
# ---------------------------------------------------------------------------

# Named character entities (HTML 4 set) from the standard library.
NAMED_ENTITIES = {f"&{name};": chr(cp) for name, cp in html.entities.name2codepoint.items()}

GOOD_LINK = r"\[\[[^\[]*?\]\]"
BAD_LEFT_LINK = r"\[[^\[]*?\]\]"
BAD_RIGHT_LINK = r"\[\[[^\[]*?\]"


def _lit_array(xs):
    return F.array(*[F.lit(x) for x in xs])


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: all surrounding whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _when_has(t: Column, ch: str, transformed: Column) -> Column:
    """Apply ``transformed`` only when ``t`` holds ``ch`` (every pattern of the
    step needs it, so the result is the same; the regex passes are skipped)."""
    return F.when(t.contains(ch), transformed).otherwise(t)


def let(x: Column, fn) -> Column:
    """``fn(x)`` with ``x`` evaluated once, however often ``fn`` reads it: inside a
    lambda Catalyst evaluates every occurrence of a common subexpression again."""
    return F.get(F.transform(F.array(x), fn), 0)


# E1 ---------------------------------------------------------------------------
def title_as_link(t: Column) -> Column:
    """First ``'''`` becomes ``[[``, the next one ``]]``."""
    t = F.regexp_replace(t, r"(?s)^(.*?)'''", "$1[[")
    return F.regexp_replace(t, r"(?s)^(.*?)'''", "$1]]")


# E2 ---------------------------------------------------------------------------
def unescape_angle(t: Column) -> Column:
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("<<", "«"), (">>", "»")]:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# E3 ---------------------------------------------------------------------------
def drop_comments(t: Column) -> Column:
    return F.regexp_replace(t, r"(?s)<!--.*?-->", "")


# E4-E6 ------------------------------------------------------------------------
def garbage_tag_pattern(tag: str) -> str:
    return rf"(?si)<\s*{tag}(\s*| [^/]+?)>.*?<\s*/\s*{tag}\s*>"


def wrapper_tag_patterns(tag: str) -> tuple[str, str]:
    return rf"(?si)<\s*{tag}(\s*| [^/]+?)>", rf"(?si)<\s*/\s*{tag}\s*>"


def single_tag_patterns(tag: str) -> tuple[str, str]:
    return (rf"(?si)<\s*{tag}(\s*| .+?)/\s*>",
            rf"(?si)<\s*(/|\\)?\s*{tag}(\s*| [^/]+?)\\?\s*>")


def _tag_names(t: Column) -> Column:
    """The names that stand where a pattern of E4-E6 looks for its tag's."""
    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"<\s*[/\\]?\s*([A-Za-z0-9]+)"), 1), F.lower))


def _drop_tags(t: Column, tags: list[str], patterns) -> Column:
    """The patterns of one tag after the other removed. Patterns run for tags
    whose name stands in the text as the tags before have left it."""
    def step(acc, tag):
        out = acc["t"]
        for pattern in patterns("\0"):
            first, *rest = pattern.split("\0")
            out = F.regexp_replace(out, F.concat(F.lit(first), *[x for r in rest for x in (tag, F.lit(r))]), F.lit(""))
        return F.when(F.array_contains(acc["names"], tag), let(
            out, lambda x: F.struct(x.alias("t"), _tag_names(x).alias("names")))).otherwise(acc)

    start = F.struct(t.alias("t"), _tag_names(t).alias("names"))
    return _when_has(t, "<", F.aggregate(_lit_array(tags), start, step)["t"])


def drop_garbage_tags(t: Column, tags=None) -> Column:
    """Tags removed together with their content."""
    return _drop_tags(t, tags or GARBAGE_TAGS, lambda tag: (garbage_tag_pattern(tag),))


def drop_wrapper_tags(t: Column, tags=None) -> Column:
    """E5: opening and closing tags removed, content kept."""
    return _drop_tags(t, tags or WRAPPER_TAGS, wrapper_tag_patterns)


def drop_single_tags(t: Column, tags=None) -> Column:
    """Self-closing tags, well or badly formed."""
    return _drop_tags(t, tags or SINGLE_TAGS, single_tag_patterns)


# E7 ---------------------------------------------------------------------------
def placeholders(t: Column) -> Column:
    """``<math>`` -> ``formula_N``, ``<code>`` -> ``codice_N``; equal blocks keep
    the first number, the counter still advances per match."""
    def numbered(name):
        def step(acc, m):
            label = F.concat(F.lit(name + "_"), acc["i"].cast("string"))
            return F.struct(F.replace(acc["t"], m, label).alias("t"), (acc["i"] + 1).alias("i"))
        return step

    out = t
    for tag, name in PLACEHOLDER_TAGS:
        matches = F.regexp_extract_all(out, F.lit(garbage_tag_pattern(tag)), 0)
        start = F.struct(out.alias("t"), F.lit(1).alias("i"))
        out = F.aggregate(matches, start, numbered(name))["t"]
    return _when_has(t, "<", out)


# E8 ---------------------------------------------------------------------------
def drop_templates(t: Column, passes: int = 3) -> Column:
    """Tables and templates: collapse double braces, then remove ``{...}`` three
    times (so three nesting levels)."""
    out = t
    for a, b in [("{{end box}}", "}"), ("{{", "{"), ("}}", "}"), ("{|", "{"), ("|}", "}")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    for _ in range(passes):
        out = F.regexp_replace(out, r"(?s)\{[^{]*?\}", "")
    # every replacement above needs a brace ("|}" included)
    return F.when(t.contains("{") | t.contains("}"), out).otherwise(t)


# E17 --------------------------------------------------------------------------
def _drop_trailing_empty(arr: Column) -> Column:
    return let(arr, lambda a: let(F.array_position(F.reverse(F.transform(a, lambda x: x != "")), True), lambda keep: F.when(
        keep == 0, F.array().cast("array<string>")).otherwise(F.slice(a, 1, F.size(a) - keep + 1))))


def parse_wikilink(inner: Column) -> Column:
    """Wikilink body -> ``struct(title, text)``.

    Leading ``:`` skipped; project namespaces use the last part; garbage
    namespaces give empty; other namespaces give empty unless piped; text is
    the last ``|`` part after ``#`` and ``/``; title is the part before it.
    """
    def link(first, toks, ns, pipes, text):
        n = F.size(pipes)
        title = F.when(n > 1, _strip(F.element_at(pipes, -2))).otherwise(text)
        plain = (F.size(toks) == 1) | ns.isin(PROJECT_NAMESPACES)
        empty = ((first == 0) | (n == 0) | (~plain & ns.isin(GARBAGE_NAMESPACES))
                 | (~plain & (n == 1)))
        return F.when(empty, F.struct(F.lit("").alias("title"), F.lit("").alias("text"))) \
            .otherwise(F.struct(title.alias("title"), text.alias("text")))

    def of_pipes(first, toks, pipes):
        text = _strip(F.element_at(F.split(F.element_at(F.split(F.try_element_at(pipes, F.lit(-1)), "#", -1), -1),
                                           "/", -1), -1))
        ns = F.lower(_strip(F.get(toks, 0)))
        return let(ns, lambda ns: let(text, lambda text: link(first, toks, ns, pipes, text)))

    def of_parts(parts, first):
        toks = F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts))
        return let(toks, lambda toks: let(_drop_trailing_empty(F.split(F.element_at(toks, -1), r"\|", -1)),
                                          lambda pipes: of_pipes(first, toks, pipes)))

    return let(F.split(inner, ":", -1), lambda parts: let(
        F.array_position(F.transform(parts, lambda x: x != ""), True), lambda first: of_parts(parts, first)))


def _inner(m: Column, left: int, right: int) -> Column:
    return F.substring(m, left + 1, F.length(m) - left - right)


# E9-E10 -----------------------------------------------------------------------
# (pattern, braces on the left and on the right, whether its links are kept and
# the underscores of its texts become spaces)
LINK_PASSES = [(GOOD_LINK, 2, 2, True), (GOOD_LINK, 2, 2, False), (BAD_LEFT_LINK, 1, 2, True), (BAD_RIGHT_LINK, 2, 1, True)]


def _found_links(t: Column, pattern: str) -> Column:
    return F.when(t.contains("["), F.regexp_extract_all(t, F.lit(pattern), 0)) \
        .otherwise(F.array().cast("array<string>"))


def _parsed_links(found: Column, left: int, right: int) -> Column:
    return F.transform(found, lambda m: F.struct(m.alias("match"), parse_wikilink(_inner(m, left, right)).alias("link")))


def _linked(t: Column, links: Column, parsed: Column, pattern: str, keep: bool) -> tuple[Column, Column]:
    def text(x):
        return F.replace(x["link"]["text"], F.lit("_"), F.lit(" ")) if keep else x["link"]["text"]

    out = F.aggregate(parsed, t, lambda acc, x: F.replace(acc, x["match"], text(x)))
    if pattern == BAD_RIGHT_LINK:
        out = F.when(t.contains("["), F.replace(F.replace(out, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))).otherwise(out)
    return out, F.concat(links, F.transform(parsed, lambda x: x["link"])) if keep else links


def with_links_resolved(df: DataFrame, *keep: str) -> DataFrame:
    """E9-E10 on the columns ``text`` and ``links``: every pass finds its links,
    parses each once and puts the texts in, in projections of their own."""
    for pattern, left, right, kept in LINK_PASSES:
        df = df.select(*keep, "text", "links", _found_links(F.col("text"), pattern).alias("found"))
        df = df.select(*keep, "text", "links", _parsed_links(F.col("found"), left, right).alias("parsed"))
        t, links = _linked(F.col("text"), F.col("links"), F.col("parsed"), pattern, kept)
        df = df.select(*keep, t.alias("text"), links.alias("links"))
    return df


def resolve_links(t: Column) -> tuple[Column, Column]:
    """E9-E10 in one expression (for single values and tests)."""
    links = F.array().cast("array<struct<title:string,text:string>>")
    for pattern, left, right, kept in LINK_PASSES:
        t, links = _linked(t, links, _parsed_links(_found_links(t, pattern), left, right), pattern, kept)
    return t, links


# E11 --------------------------------------------------------------------------
def drop_http_links(t: Column) -> Column:
    out = F.replace(F.regexp_replace(t, r"(?si)\[http.*?\]", ""), F.lit("[]"), F.lit(""))
    return _when_has(t, "[", out)


# E12 --------------------------------------------------------------------------
def bold_italic(t: Column) -> Column:
    bold = r"(?s)\w'('''[^\s'][^']*?[^\s']''')[^']"
    italic = r"(?s)\w'(''[^\s'][^']*?[^\s']'')[^']"
    src = t
    b = F.regexp_extract_all(t, F.lit(bold), 1)
    t = F.aggregate(b, t, lambda acc, m: F.replace(acc, m, F.substring(m, 4, F.length(m) - 6)))
    i = F.regexp_extract_all(t, F.lit(italic), 1)
    t = F.aggregate(i, t, lambda acc, m: F.replace(
        acc, m, F.concat(F.lit("&quot;"), F.substring(m, 3, F.length(m) - 4), F.lit("&quot;"))))
    return _when_has(src, "'", F.replace(F.replace(t, F.lit("'''"), F.lit("")), F.lit("''"), F.lit("&quot;")))


# E13 --------------------------------------------------------------------------
_ENTITY_MAP = None


def _entity_map() -> Column:
    items = []
    for k, v in sorted(NAMED_ENTITIES.items()):
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def named_entities(t: Column) -> Column:
    """``&amp;`` first (so double escapes decode), doubled quotes collapsed, then
    every named entity present in the text replaced by its character."""
    src = t
    t = F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&quot;&quot;"), F.lit("&quot;"))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&[A-Za-z0-9]+;"), 0))
    emap = _entity_map()
    return _when_has(src, "&", F.aggregate(
        found, t, lambda acc, m: F.replace(acc, m, F.coalesce(F.element_at(emap, m), m))))


# E14 --------------------------------------------------------------------------
def numeric_entities(t: Column) -> Column:
    """``&#N;`` -> the character; code points from 0x10000 up -> empty."""
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#\d+?;"), 0))

    def char(m):
        n = F.regexp_extract(m, r"(\d+)", 1).cast("bigint")
        ch = F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
        return F.when(n >= 0x10000, F.lit("")).otherwise(ch)

    return _when_has(t, "&#", F.aggregate(found, t, lambda acc, m: F.replace(acc, m, char(m))))


# E15 --------------------------------------------------------------------------
SPACING_FIXES = [(" ,", ","), (" .", "."), (" :", ":"), (" ;", ";"), (",,", ","), (",.", "."),
                 ("( ", "("), (" )", ")"), ("[ ", "["), (" ]", "]"), ("« ", "«"), (" »", "»")]


def fix_spacing(t: Column) -> Column:
    t = F.replace(t, F.lit("\t"), F.lit(" "))
    t = F.regexp_replace(t, r" {2,}", " ")
    t = F.regexp_replace(t, r"\.{4,}", "...")
    for a, b in SPACING_FIXES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


# E16 --------------------------------------------------------------------------
def keep_line(line: Column) -> Column:
    """Line filter of the compact step (``line`` is already stripped)."""
    first, last = F.substring(line, 1, 1), F.substring(line, -1, 1)
    return ((line != "")
            & ~line.startswith("++") & ~line.startswith("==")
            & ~((last == ":") | first.isin("*", "#", ":", ";"))
            & ~(first.isin("{", "|") | (last == "}"))
            & ~(((first == "(") & (last == ")")) | line.rlike(r"^[.\-]*$"))
            & ~(~line.contains("_") & (F.size(F.split(line, r"\s+")) < 6)))


def compact(t: Column) -> Column:
    lines = F.transform(F.split(t, "\n"), _strip)
    return F.array_join(F.filter(lines, keep_line), "\n")


# E21 --------------------------------------------------------------------------
def delete_chars(t: Column, chars: str = "=;*") -> Column:
    """Characters ``=``, ``;``, ``*`` deleted (the original iterates characters)."""
    return F.translate(t, chars, "")


# E23 --------------------------------------------------------------------------
def first_lines(t: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(F.split(t, "\n"), 1, n), "\n")


# E22 --------------------------------------------------------------------------
# Steps before and after link resolution, in order. Each is applied as its own
# projection so that a step using its input twice never duplicates the
# expression tree of the earlier steps.
STEPS_BEFORE_LINKS = [title_as_link, unescape_angle, drop_comments, drop_garbage_tags,
                      drop_wrapper_tags, drop_single_tags, placeholders, drop_templates]
STEPS_AFTER_LINKS = [drop_http_links, bold_italic, named_entities, numeric_entities,
                     fix_spacing, compact, delete_chars]
