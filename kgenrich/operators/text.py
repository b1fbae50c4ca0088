"""From raw articles to tagged sentences.

A sentence is one row ``(title, sent_id, words array<struct<segment, lemma,
tag, parse>>)`` so every per-sentence rule (numerals, lemma fixes, windows)
is a higher-order function on the array: no shuffle, no Python. The only
shuffle of whole articles brings them together with their link dictionary and
true-cased forms, both small maps; tokens are never dealt out one by one unless
a lexicon is given (a join on the word form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LEMMA_OVERRIDES, MILLION_WORDS, THOUSAND_WORDS
from ..functions import markup
from ..functions.values import is_numeric, try_double
from ..session import stage_table

WORD = "struct<segment:string,lemma:string,tag:string,parse:string>"
# Unicode white space, spelled out: Java's ``\s`` is ASCII only, and cleaned
# articles hold non-breaking spaces (also as thousands separators).
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# A sentence ends after a run of terminators, or one terminator before white
# space or the line's end (``3.5`` goes on). No group is repeated: Java's regex
# engine recurses once per repetition of a group and overflows on long lines.
SENTENCE_END = rf"([.!?]{{2,}}|[.!?](?=[{SPACE}]|$))"
MARK = "\x01"
TOKEN_RE = rf"\p{{L}}+|\d+|[^{SPACE}\p{{L}}\d]"


# --- E22 / E23 -----------------------------------------------------------------

ARTICLES_PER_PARTITION = 1000


def spread(articles: DataFrame) -> DataFrame:
    """The articles dealt out in partitions of about ARTICLES_PER_PARTITION. Cleaning
    costs far more than reading, and one row group or compressed file is one task."""
    return articles.repartition(articles.count() // ARTICLES_PER_PARTITION + 1)


def clean_articles(articles: DataFrame, text_col: str = "wikitext",
                   keep_lines: int | None = None) -> DataFrame:
    """``(title, page_id, text, links)``; optional E23 line limit.

    Every step is its own projection: a step that reads its input twice
    then reads an attribute, and Catalyst keeps the projections apart
    instead of inlining a non-cheap expression twice."""
    df = spread(articles.select("title", "page_id", F.col(text_col).alias("text")))
    for step in markup.STEPS_BEFORE_LINKS:
        df = df.select("title", "page_id", step(F.col("text")).alias("text"))
    df = df.withColumn("links", F.array().cast("array<struct<title:string,text:string>>"))
    df = markup.with_links_resolved(df, "title", "page_id")
    for step in markup.STEPS_AFTER_LINKS:
        df = df.select("title", "page_id", step(F.col("text")).alias("text"), "links")
    if keep_lines is not None:
        df = df.select("title", "page_id", markup.first_lines(F.col("text"), keep_lines).alias("text"), "links")
    return df


# --- E18-E20: link dictionary ---------------------------------------------------

def canonical_title(title: Column) -> Column:
    """Spaces to ``_``, first letter upper-cased (ASCII letters only)."""
    t = F.replace(title, F.lit(" "), F.lit("_"))
    first = F.substring(t, 1, 1)
    return F.concat(F.when(first.rlike("^[a-z]$"), F.upper(first)).otherwise(first),
                    F.substring(t, 2, 1 << 30))


def _with_hyphen_parts(parts: Column) -> Column:
    extra = F.flatten(F.transform(F.filter(parts, lambda x: x.contains("-")),
                                  lambda x: F.split(x, "-", -1)))
    return F.concat(parts, extra)


def _common_prefix_len(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    miss = F.filter(idx, lambda i: F.substring(a, i, 1) != F.substring(b, i, 1))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(miss) - 1, n))


def link_dictionary(clean: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per article ``(title, links_map map<token, title token>)``.

    Each anchor token is paired with each token of the linked title (both
    also split on ``-``) sharing the first two letters (case-insensitive),
    when the linked title is a catalog entity. Conflicts: the candidate with
    the longer common prefix with the token wins, then the longer one, then
    the larger (a total order)."""
    best = link_pairs(clean, catalog)
    return best.groupBy("title").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("links_map"))


def link_pairs(clean: DataFrame, catalog: DataFrame) -> DataFrame:
    """The entries of the link dictionaries: ``(title, t, n)``."""
    # explode_outer: a plain explode makes Catalyst infer ``size(links) > 0``
    # and push it below the cleaning projections, evaluating them twice
    links = clean.select("title", F.explode_outer("links").alias("l")) \
        .where(F.col("l.text") != "") \
        .select("title", F.replace(F.col("l.text"), F.lit(" "), F.lit("_")).alias("anchor"),
                canonical_title(F.col("l.title")).alias("link_name"))
    links = links.join(catalog.select(F.col("name").alias("link_name")), "link_name", "left_semi")
    pairs = links.select(
        "title",
        F.explode(_with_hyphen_parts(F.split("anchor", "_", -1))).alias("t"),
        _with_hyphen_parts(F.split("link_name", "_", -1)).alias("ns"))
    pairs = pairs.select("title", "t", F.explode("ns").alias("n")) \
        .where(F.left(F.lower("t"), F.lit(2)) == F.left(F.lower("n"), F.lit(2)))
    return pairs.groupBy("title", "t").agg(F.max_by(
        "n", F.struct(_common_prefix_len(F.col("t"), F.col("n")), F.length("n"), F.col("n"))).alias("n"))


# --- F1: sentences and tokens --------------------------------------------------------

def split_sentences(text: Column) -> Column:
    """Lines, then sentences: runs ending in ``.!?`` (a mark followed by a
    non-space, as in ``3.5``, does not end a sentence). Pieces of terminators
    only are no sentences."""
    per_line = F.transform(F.split(F.replace(text, F.lit(MARK), F.lit(" ")), "\n"), lambda line: F.split(
        F.regexp_replace(line, SENTENCE_END, "$1" + MARK), MARK))
    sents = F.transform(F.flatten(per_line), lambda s: markup._strip(s))
    return F.filter(sents, lambda s: (s != "") & ~s.rlike(r"^[.!?]+$"))


def tokenize(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TOKEN_RE), 0)


def sentences(clean: DataFrame, text_col: str = "text", id_col: str = "title") -> DataFrame:
    """``(id, sent_id, tokens array<string>)`` -- one row per sentence."""
    s = clean.select(id_col, F.posexplode_outer(split_sentences(F.col(text_col)))
                     .alias("sent_id", "sentence")).where(F.col("sentence").isNotNull())
    return s.select(id_col, "sent_id", tokenize(F.col("sentence")).alias("tokens")) \
        .where(F.size("tokens") > 0)


# --- F1/F2: lexicon -----------------------------------------------------------------

def lexicon_from_corpus(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """A lexicon ``(form, lemma, tag, n)`` learnt from the corpus itself: a
    capitalised form whose lower-case form also occurs gets the lower-case
    lemma (true-casing); digits are ``num``, punctuation ``interp``, other
    forms ``ign``. Stands in for an external morphological lexicon."""
    return lexicon_from_forms(form_counts(tokens, tokens_col))


def form_counts(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(form, n)``: how often every form occurs."""
    return tokens.select(F.explode(tokens_col).alias("form")).groupBy("form") \
        .agg(F.count(F.lit(1)).alias("n"))


def lexicon_from_forms(forms: DataFrame) -> DataFrame:
    """The corpus lexicon of ``(form, n)`` rows, one per form."""
    lowers = forms.select(F.col("form").alias("lower_form")).where(F.col("form") == F.lower("form"))
    lx = forms.join(lowers, F.lower(forms.form) == lowers.lower_form, "left")
    return lx.select("form", F.coalesce("lower_form", "form").alias("lemma"), form_tag(F.col("form")).alias("tag"), "n")


def form_tag(form: Column) -> Column:
    """The corpus lexicon's tag of a form: most start with a letter, which needs no pattern."""
    first = F.ascii(form)
    return F.when(first.between(97, 122) | first.between(65, 90), "ign").when(form.rlike(r"^\d+$"), "num").when(form.rlike(r"^[^\p{L}\d]+$"), "interp").otherwise("ign")


def cased_forms(forms: DataFrame) -> DataFrame:
    """``(form, lemma)``: the forms whose lemma in the corpus lexicon is another."""
    low = forms.select(F.col("form").alias("lemma")).where(F.col("form") == F.lower("form"))
    up = forms.select("form").where(F.col("form") != F.lower("form"))
    return up.join(low, F.lower("form") == F.col("lemma")).select("form", "lemma")


def _word(seg: Column, lemma: Column, tag: Column, parse: Column | None = None) -> Column:
    return F.struct(seg.alias("segment"), lemma.alias("lemma"), tag.alias("tag"),
                    (parse if parse is not None else F.lit("")).alias("parse"))


def tag_sentences(sents: DataFrame, lexicon: DataFrame | None = None,
                  id_col: str = "title", unique_forms: bool = False) -> DataFrame:
    """F1-F2: ``(id, sent_id, words)``. Without a lexicon every form is its own
    lemma with tag ``ign``. With one, each form takes its most frequent
    ``(lemma, tag)`` (``unique_forms``: the lexicon has one row per form
    already, so no aggregation); unknown forms fall back the same way."""
    if lexicon is None:
        return sents.select(id_col, "sent_id", F.transform(
            "tokens", lambda t: _word(t, t, F.lit("ign"))).alias("words"))
    if unique_forms:
        best = lexicon.select("form", F.struct("lemma", "tag").alias("lt"))
    else:
        best = lexicon.groupBy("form").agg(F.max_by(F.struct("lemma", "tag"), F.struct("n", "lemma", "tag")).alias("lt"))
    toks = sents.select(id_col, "sent_id", F.posexplode("tokens").alias("pos", "form"))
    j = toks.join(best, "form", "left")
    w = F.struct("pos", _word(F.col("form"), F.coalesce("lt.lemma", "form"),
                               F.coalesce("lt.tag", F.lit("ign"))).alias("w"))
    g = j.groupBy(id_col, "sent_id").agg(F.array_sort(F.collect_list(w)).alias("ws"))
    return g.select(id_col, "sent_id", F.transform("ws", lambda x: x["w"]).alias("words"))


# --- F8-F10: lemma corrections ---------------------------------------------------------

def correct_lemmas(words: Column, links_map: Column | None = None) -> Column:
    """F8 link lemma, F9 overrides, F10 capitalised word keeps its segment."""
    over = F.create_map(*[F.lit(x) for kv in LEMMA_OVERRIDES.items() for x in kv])

    def fix(w):
        lemma = w["lemma"]
        if links_map is not None:
            lemma = F.coalesce(F.element_at(links_map, w["segment"]), lemma)
        return markup.let(lemma, lambda x: _word(w["segment"], F.coalesce(F.element_at(over, x), x), w["tag"], w["parse"]))

    fixed = F.transform(words, fix)

    def cap(w, i):
        up = F.substring(w["segment"], 1, 1).rlike(r"^\p{Lu}$")
        low = F.substring(w["lemma"], 1, 1).rlike(r"^\p{Ll}$")
        return F.when((i > 0) & (w["segment"] != w["lemma"]) & up & low, _word(w["segment"], w["segment"], w["tag"], w["parse"])) \
            .otherwise(w)

    return F.transform(fixed, cap)


# --- F5-F7: numerals ---------------------------------------------------------------------

def _num(w: Column) -> Column:
    return is_numeric(w["lemma"])


def _numword(lemma: Column, tag: Column) -> Column:
    return _word(lemma, lemma, tag, F.lit(""))


def _if_numerals(words: Column, between: str, joined: Column) -> Column:
    """``joined`` for sentences that may hold two numerals with ``between`` (a
    pattern over lemmas, MARK after each) from one to the other, else ``words``.
    A numeral has a digit and no MARK, so one pass over the lemmas tells."""
    lemmas = F.array_join(F.transform(words, lambda w: w["lemma"]), MARK)
    near = lemmas.rlike(rf"\d[^{MARK}]*{MARK}{between}[^{MARK}]*\d")
    return F.when(~near, words).when(F.size(F.filter(words, _num)) < 2, words).otherwise(joined)


def join_decimal_numerals(words: Column) -> Column:
    """``3 , 5`` -> ``3,5`` and ``1 . 000`` -> ``1000`` in one left-to-right,
    non-chaining pass (the separator test is a substring test of ``.,``)."""
    n = F.size(words)
    init = F.struct(F.array().cast(f"array<{WORD}>").alias("out"), F.lit(0).alias("skip"))

    def step(acc, i):
        w0 = F.get(words, i)
        w1, w2 = F.get(words, i + 1), F.get(words, i + 2)
        sep = w1["lemma"]
        hit = (i + 2 < n) & _num(w0) & sep.isin("", ".", ",", ".,") & _num(w2)
        merged = F.when(sep == ".", F.concat(w0["lemma"], w2["lemma"])) \
            .otherwise(F.concat(w0["lemma"], F.lit(","), w2["lemma"]))
        return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))) \
            .when(hit, F.struct(F.array_append(acc["out"], _numword(merged, w0["tag"])).alias("out"),
                                F.lit(2).alias("skip"))) \
            .otherwise(F.struct(F.array_append(acc["out"], w0).alias("out"), F.lit(0).alias("skip")))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return _if_numerals(words, rf"(?:|[.,]|\.,){MARK}", F.aggregate(places, init, step)["out"])


def join_adjacent_numerals(words: Column) -> Column:
    """adjacent numerals concatenated, chaining (``100 000`` -> ``100000``)."""
    init = F.array().cast(f"array<{WORD}>")

    def step(acc, w):
        last = F.element_at(acc, -1)
        hit = (F.size(acc) > 0) & _num(last) & _num(w)
        merged = _numword(F.concat(last["lemma"], w["lemma"]), last["tag"])
        return F.when(hit, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), merged)) \
            .otherwise(F.array_append(acc, w))

    return _if_numerals(words, "", F.aggregate(words, init, step))


def apply_multipliers(words: Column) -> Column:
    """number + thousand/million word -> the product (rounded half away
    from zero); a ``.`` after ``tys`` is swallowed."""
    n = F.size(words)
    thousand, million = THOUSAND_WORDS, MILLION_WORDS
    init = F.struct(F.array().cast(f"array<{WORD}>").alias("out"), F.lit(0).alias("skip"))

    def step(acc, i):
        w0, w1, w2 = F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)
        hit = (i + 1 < n) & _num(w0) & w1["lemma"].isin(*(thousand + million))
        factor = F.when(w1["lemma"].isin(*thousand), F.lit(1000.0)).otherwise(F.lit(1000000.0))
        value = F.round(try_double(w0["lemma"]) * factor, 0).cast("bigint").cast("string")
        swallow = (w1["lemma"] == "tys") & (i + 2 < n) & (w2["lemma"] == ".")
        return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))) \
            .when(hit, F.struct(F.array_append(acc["out"], _numword(value, w0["tag"])).alias("out"),
                                F.when(swallow, 2).otherwise(1).alias("skip"))) \
            .otherwise(F.struct(F.array_append(acc["out"], w0).alias("out"), F.lit(0).alias("skip")))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    scaled = F.exists(words, lambda w: w["lemma"].isin(*(thousand + million)))
    return F.when(~scaled, words).otherwise(F.aggregate(places, init, step)["out"])


def join_numerals(words: Column) -> Column:
    """F5-F7 in one expression (single values and tests; DataFrames should
    apply the three stages as separate projections, see ``prepare_articles``)."""
    return apply_multipliers(join_adjacent_numerals(join_decimal_numerals(words)))


# --- F11, F18, F19: article preparation ----------------------------------------------------

def prepare_articles(raw: DataFrame, catalog: DataFrame, lexicon: DataFrame | None = None,
                     names: DataFrame | None = None, done: DataFrame | None = None,
                     line_limit: int | None = None,
                     sentence_limit: int | None = None,
                     corpus_lexicon: bool = True) -> DataFrame:
    """Raw articles -> ``sentences(title, sent_id, words)``.

    ``names`` restricts to requested titles (A3: a semi join; names without an
    article simply produce nothing), ``done`` skips titles already prepared
    (F18, an anti join). Clean (E22), first lines (E23), split and tag (F1,
    F2), correct lemmas with the link dictionary (F8-F10), join numerals
    (F5-F7). Whole texts by default; ``line_limit`` / ``sentence_limit``
    (``ARTICLE_SENTENCE_LIMIT`` = 10 in the original) keep only the first
    lines before tagging (E23) and the first sentences after (F19)."""
    if names is not None:
        raw = raw.join(names.select(F.col(names.columns[0]).alias("title")), "title", "left_semi")
    if done is not None:
        raw = raw.join(done.select("title").distinct(), "title", "left_anti")
    arts = _tokenised(clean_articles(raw, keep_lines=line_limit))
    cased = None
    if lexicon is None and corpus_lexicon:
        cased = cased_forms(form_counts(arts.select(F.flatten("sents").alias("tokens"))))
    return _prepare(arts, catalog, lexicon, cased, sentence_limit)


def prepare_clean(clean: DataFrame, catalog: DataFrame, lexicon: DataFrame | None = None,
                  unique_forms: bool = False, sentence_limit: int | None = None) -> DataFrame:
    """Cleaned articles -> ``sentences(title, sent_id, words)``: tags, lemmas, numerals.
    ``unique_forms``: the lexicon is one of ``lexicon_from_forms`` that holds every form."""
    if unique_forms:
        return _prepare(_tokenised(clean), catalog, None, lexicon.where("lemma <> form").select("form", "lemma"), sentence_limit)
    return _prepare(_tokenised(clean), catalog, lexicon, None, sentence_limit)


def _tokenised(clean: DataFrame) -> DataFrame:
    """``(title, links, sents array<array<string>>)`` as a stage table: cleaned and
    split once, while the forms, the links and the tags all read it."""
    sents = F.transform(split_sentences(F.col("text")), tokenize)
    return stage_table(clean.select("title", "links", sents.alias("sents")), "articles")


def _merged(lists: Column) -> Column:
    """The sentences of a title. Those of several articles are joined token by
    token: place by place in the sentence, in the order of the tokens."""
    def sentence(i):
        parts = F.filter(F.transform(lists, lambda a: F.get(a, i)), lambda a: F.size(a) > 0)
        longest = F.array_max(F.transform(parts, lambda a: F.size(a)))
        return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(
            F.sequence(F.lit(0), longest - 1),
            lambda k: F.array_sort(F.filter(F.transform(parts, lambda a: F.get(a, k)), lambda x: x.isNotNull())))))

    most = F.array_max(F.transform(lists, lambda a: F.size(a)))
    return F.when(F.size(lists) == 1, F.get(lists, 0)) \
        .when(most > 0, F.transform(F.sequence(F.lit(0), most - 1), sentence))


def _prepare(arts: DataFrame, catalog: DataFrame, lexicon: DataFrame | None, cased: DataFrame | None,
             sentence_limit: int | None) -> DataFrame:
    links = link_pairs(arts, catalog)
    if cased is None:
        sents = arts.select("title", F.posexplode("sents").alias("sent_id", "tokens")).where(F.size("tokens") > 0)
        ld = links.groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("links_map"))
        t = tag_sentences(sents, lexicon).join(ld, "title", "left")
    else:
        t = _tag_by_case(arts, links, cased)
    if sentence_limit is not None:
        t = t.where(F.col("sent_id") < sentence_limit)
    # one projection per array stage: the numeral passes index their input
    # per element, so an inlined input would be recomputed per element
    t = t.select("title", "sent_id", correct_lemmas(F.col("words"), F.col("links_map")).alias("words"))
    for stage in (join_decimal_numerals, join_adjacent_numerals, apply_multipliers):
        t = t.select("title", "sent_id", stage(F.col("words")).alias("words"))
    return t


def _tag_by_case(arts: DataFrame, links: DataFrame, cased: DataFrame) -> DataFrame:
    """``(title, sent_id, words, links_map)``, tagged by the corpus lexicon, of which
    only the forms with another lemma (``cased``) are looked up, each once an article.
    One exchange on the title brings articles, their forms and their links together."""
    pair = "struct<a:string,b:string>"
    none = F.lit(None).cast(pair)
    rows = arts.select("title", "sents", none.alias("form"), none.alias("link")).unionByName(links.where("title is not null").select(
        "title", F.lit(None).cast("array<array<string>>").alias("sents"), none.alias("form"),
        F.struct(F.col("t").alias("a"), F.col("n").alias("b")).alias("link")))
    up = arts.select("title", F.explode(F.filter(F.array_distinct(F.flatten("sents")), lambda f: f != F.lower(f))).alias("form"))
    up = up.join(stage_table(cased, "cased_forms"), "form")
    rows = rows.unionByName(up.select(
        "title", F.lit(None).cast("array<array<string>>").alias("sents"),
        F.struct(F.col("form").alias("a"), F.col("lemma").alias("b")).alias("form"), none.alias("link")))
    one = rows.groupBy("title").agg(F.collect_list("sents").alias("lists"), F.collect_set("form").alias("forms"),
                                    F.collect_list("link").alias("links"))
    one = one.select("title", _merged(F.col("lists")).alias("sents"), F.map_from_entries("forms").alias("forms"),
                     F.map_from_entries("links").alias("links_map"))
    s = one.select("title", "forms", "links_map", F.posexplode_outer("sents").alias("sent_id", "tokens")).where(F.size("tokens") > 0)
    return s.select("title", "sent_id", F.transform("tokens", lambda f: _word(
        f, F.coalesce(F.element_at("forms", f), f), form_tag(f))).alias("words"), "links_map")


def get_articles(sentences: DataFrame, names: DataFrame,
                 sentence_limit: int | None = None) -> DataFrame:
    """A4: prepared sentences of the requested titles (a semi join; missing
    titles give no rows); optionally only the first ``sentence_limit``."""
    n = names.select(F.col(names.columns[0]).alias("title")).distinct()
    out = sentences.join(n, "title", "left_semi")
    return out if sentence_limit is None else out.where(F.col("sent_id") < sentence_limit)
