"""Registered queries (one per operator id of the blueprint) and their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, reads the whole driver tables (or data
Spark derives from them) and returns a DataFrame with flat, aliased columns.
``ORACLE[name]`` is the equivalent DuckDB SQL over the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import LEARNING_CURVE_CAPS, PREDOMINANT_SHARE, TRAINING_LIMIT, WIDE_TYPES
from ..functions import iri
from ..functions import markup as mk
from ..functions import tags as tg
from ..functions import values as vals
from ..operators import catalog as cat
from ..operators import evaluate as ev
from ..operators import extract as ex
from ..operators import graph, paper, senses
from ..operators import supervise as sup
from ..operators import text as tx
from ..session import checkpoint_dir, stage_path, stage_table
from ..sources import dump
from ..sources import gold as gold_io
from ..sources import ntriples as nt
from ..streaming import incremental
from . import testkg as kg
from .oracle import labelled_ctes, pairs_ctes, sentences_ctes, sql_list, with_kg

# What a sentence is, as one matching pattern; the engine splits at sentence ends instead.
_SENTENCE = r"(?:[^.!?]+|[.!?][^\s.!?])[^.!?]*(?:[.!?][^\s.!?][^.!?]*)*[.!?]*"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _graph(spark: SparkSession, sf: str):
    t = kg.triples(spark, sf)
    return t, kg.types(t)


# --- C: graph queries --------------------------------------------------------

@register("c1_triple_pattern", with_kg(
    "select s, o from kg_triples where p = 'nation'"))
def c1(spark, sf):
    t, _ = _graph(spark, sf)
    return graph.select_all(t, p="nation")


@register("c2_subject_types", with_kg("""
select f.s, t.type, cast(count(*) as bigint) as n
from kg_facts f join kg_types t on f.s = t.entity
where f.p = 'nation' group by f.s, t.type"""))
def c2(spark, sf):
    t, ty = _graph(spark, sf)
    r = graph.subject_types(t, ty, "nation")
    return r.select("s", "type", F.col("n").cast("bigint").alias("n"))


@register("c3_count_by_type", with_kg(
    "select type, cast(count(*) as bigint) as n from kg_types group by type"))
def c3(spark, sf):
    _, ty = _graph(spark, sf)
    return graph.count_entities_of_type(ty)


@register("c4_entities_of_type", with_kg(
    "select entity from kg_types where type = 'Customer'"))
def c4(spark, sf):
    _, ty = _graph(spark, sf)
    return graph.entities_of_type(ty, "Customer")


@register("c5_type_not_in_relation", with_kg("""
select entity from kg_types t where type = 'Customer'
and not exists (select 1 from kg_facts f where f.p = 'nation' and f.s = t.entity)"""))
def c5(spark, sf):
    t, ty = _graph(spark, sf)
    return graph.entities_of_type_not_in_relation(ty, t, "Customer", "nation")


@register("c6_type_in_relation", with_kg("""
select f.s, f.o from kg_facts f join kg_types t on f.s = t.entity
where f.p = 'balance' and t.type = 'Customer'"""))
def c6(spark, sf):
    t, ty = _graph(spark, sf)
    return graph.entities_of_type_in_relation(ty, t, "Customer", "balance")


@register("c7_distinct_subjects", with_kg("select distinct s from kg_triples"))
def c7(spark, sf):
    t, _ = _graph(spark, sf)
    return graph.all_subjects(t)


@register("c8_iri_roundtrip", with_kg(f"""
select '{iri.DATA_SOURCE}/resource/' || replace(url_encode(s), '%2F', '/') as s_iri,
       '{iri.DATA_SOURCE}/property/' || replace(url_encode(p), '%2F', '/') as p_iri,
       s as s_back
from kg_facts"""))
def c8(spark, sf):
    t, _ = _graph(spark, sf)
    f = kg.facts(t)
    out = f.select(iri.resource_iri(F.col("s")).alias("s_iri"),
                   iri.property_iri(F.col("p")).alias("p_iri"))
    return out.select("s_iri", "p_iri", iri.local_name(F.col("s_iri")).alias("s_back"))


# --- D: catalog and candidates ---------------------------------------------

_CAT = sql_list(kg.CATALOG_TYPES)
_WIDE = sql_list(WIDE_TYPES)


@register("d1_catalog", with_kg(f"""
with t as (select entity as name, type from kg_types where type in {_CAT.replace('[', '(').replace(']', ')')}),
u as (select * from t union all
      select split_part(name, '_(', 1) as name, type from t where contains(name, '_('))
select name, array_to_string(list_sort(list(distinct type)), ',') as types
from u group by name"""))
def d1(spark, sf):
    _, ty = _graph(spark, sf)
    c = cat.build_catalog(ty, kg.CATALOG_TYPES)
    return c.select("name", F.array_join("types", ",").alias("types"))


def _predominant_sql(p: str, side: str) -> str:
    on = "f.s" if side == "subject" else "f.o"
    return f"""
select '{side}' as side, type from (
  select t.type, count(*) as cnt from kg_facts f join kg_types t on {on} = t.entity
  where f.p = '{p}' and t.type not in {_WIDE.replace('[', '(').replace(']', ')')} group by t.type) c,
 (select count(distinct f.s) as n_entities from kg_facts f join kg_types t on {on} = t.entity
  where f.p = '{p}') n
where cnt >= {PREDOMINANT_SHARE} * n_entities"""


@register("d3_predominant_types", with_kg(
    _predominant_sql("nation", "subject") + " union all " + _predominant_sql("nation", "object")))
def d3(spark, sf):
    t, ty = _graph(spark, sf)
    spec = kg.relation("nation")
    a = cat.predominant_types(t, ty, spec, True).select(F.lit("subject").alias("side"), "type")
    b = cat.predominant_types(t, ty, spec, False).select(F.lit("object").alias("side"), "type")
    return a.unionAll(b)


@register("d6_specific_types", with_kg(f"""
with pt as ({_predominant_sql('nation', 'subject')}),
sz as (select type, count(*) as n from kg_types group by type)
select pt.type, cast(sz.n as bigint) as n from pt join sz on pt.type = sz.type where sz.n > 100"""))
def d6(spark, sf):
    t, ty = _graph(spark, sf)
    pt = cat.predominant_types(t, ty, kg.relation("nation"))
    return cat.most_specific_types(pt, ty).select("type", F.col("n").cast("bigint").alias("n"))


CANDIDATES_SQL = f"""
with pt as ({_predominant_sql('nation', 'subject')}),
sz as (select type, count(*) as n from kg_types group by type),
chosen as (select pt.type from pt join sz on pt.type = sz.type where sz.n > 100
           order by sz.n, pt.type limit 1)
select entity from kg_types t join chosen c on t.type = c.type
where not exists (select 1 from kg_facts f where f.p = 'nation' and f.s = t.entity)"""


@register("d7_candidates", with_kg(CANDIDATES_SQL))
def d7(spark, sf):
    t, ty = _graph(spark, sf)
    return cat.candidates(t, ty, kg.relation("nation"))


# --- E: markup cleaning (on the raw web pages and the derived articles) ------



def _pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _duck_re(x: str, pattern: str, repl: str = "") -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"


def _duck_replace(x: str, a: str, b: str) -> str:
    a, b = a.replace("'", "''"), b.replace("'", "''")
    return f"replace({x}, '{a}', '{b}')"


def _duck_chain(x: str, fns) -> str:
    for f in fns:
        x = f(x)
    return x


_E2 = [lambda x, a=a, b=b: _duck_replace(x, a, b)
       for a, b in [("&lt;", "<"), ("&gt;", ">"), ("<<", "«"), (">>", "»")]]


@register("e2_e3_angles_comments",
          f"select page_id, {_duck_chain('html', _E2 + [lambda x: _duck_re(x, '(?s)<!--.*?-->')])} "
          "as text from pages")
def e2_e3(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", mk.drop_comments(mk.unescape_angle(F.col("html"))).alias("text"))


@register("e4_garbage_tags", "select page_id, " + _duck_chain(
    "html", [lambda x, t=t: _duck_re(x, mk.garbage_tag_pattern(t)) for t in mk.GARBAGE_TAGS])
    + " as text from pages")
def e4(spark, sf):
    return _pages(spark, sf).select("page_id", mk.drop_garbage_tags(F.col("html")).alias("text"))


@register("e5_wrapper_tags", "select page_id, " + _duck_chain(
    "html", [lambda x, p=p: _duck_re(x, p) for t in mk.WRAPPER_TAGS for p in mk.wrapper_tag_patterns(t)])
    + " as text from pages")
def e5(spark, sf):
    return _pages(spark, sf).select("page_id", mk.drop_wrapper_tags(F.col("html")).alias("text"))


@register("e6_single_tags", "select page_id, " + _duck_chain(
    "html", [lambda x, p=p: _duck_re(x, p) for t in mk.SINGLE_TAGS for p in mk.single_tag_patterns(t)])
    + " as text from pages")
def e6(spark, sf):
    return _pages(spark, sf).select("page_id", mk.drop_single_tags(F.col("html")).alias("text"))


_E8 = [lambda x, a=a, b=b: _duck_replace(x, a, b)
       for a, b in [("{{end box}}", "}"), ("{{", "{"), ("}}", "}"), ("{|", "{"), ("|}", "}")]] \
    + [lambda x: _duck_re(x, r"(?s)\{[^{]*?\}")] * 3


@register("e8_templates", with_kg(
    f"select title, {_duck_chain('wikitext', _E8)} as text from kg_articles "
    f"union all select cast(page_id as string) as title, {_duck_chain('html', _E8)} as text from pages"))
def e8(spark, sf):
    a = kg.articles(spark, sf).select("title", mk.drop_templates(F.col("wikitext")).alias("text"))
    p = _pages(spark, sf).select(F.col("page_id").cast("string").alias("title"),
                                 mk.drop_templates(F.col("html")).alias("text"))
    return a.unionAll(p)


@register("e11_http_links", "select page_id, " + _duck_replace(
    _duck_re("html", r"(?si)\[http.*?\]"), "[]", "") + " as text from pages")
def e11(spark, sf):
    return _pages(spark, sf).select("page_id", mk.drop_http_links(F.col("html")).alias("text"))


def _duck_entities(x: str) -> str:
    x = _duck_replace(_duck_replace(x, "&amp;", "&"), "&quot;&quot;", "&quot;")
    for k, v in sorted(mk.NAMED_ENTITIES.items()):
        if k != "&amp;":
            x = _duck_replace(x, k, v)
    return _duck_replace(x, "&amp;", "&")


@register("e13_named_entities", f"select page_id, {_duck_entities('html')} as text from pages")
def e13(spark, sf):
    return _pages(spark, sf).select("page_id", mk.named_entities(F.col("html")).alias("text"))


_E14_SQL = """
with t as (select page_id, html, regexp_split_to_array(html, '&#[0-9]+?;') as pieces,
                  regexp_extract_all(html, '&#[0-9]+?;') as ents from pages),
d as (select page_id, pieces, list_transform(ents, lambda e: case
        when cast(regexp_extract(e, '([0-9]+)', 1) as bigint) >= 65536 then ''
        else chr(cast(regexp_extract(e, '([0-9]+)', 1) as integer)) end) as chars from t)
select page_id, array_to_string(list_transform(range(len(pieces)),
       lambda i: pieces[i + 1] || coalesce(chars[i + 1], '')), '') as text from d"""


@register("e14_numeric_entities", _E14_SQL)
def e14(spark, sf):
    return _pages(spark, sf).select("page_id", mk.numeric_entities(F.col("html")).alias("text"))


_E15 = ([lambda x: _duck_replace(x, "\t", " "), lambda x: _duck_re(x, " {2,}", " "),
         lambda x: _duck_re(x, r"\.{4,}", "...")]
        + [lambda x, a=a, b=b: _duck_replace(x, a, b) for a, b in mk.SPACING_FIXES])


@register("e15_spacing", f"select doc_id, {_duck_chain('text', _E15)} as text from documents")
def e15(spark, sf):
    return _docs(spark, sf).select("doc_id", mk.fix_spacing(F.col("text")).alias("text"))


def _without_links(df: DataFrame) -> DataFrame:
    """The link steps as projections of their own, as the cleaner runs them."""
    df = df.withColumn("links", F.array().cast("array<struct<title:string,text:string>>"))
    return mk.with_links_resolved(df, "title").select("title", "text")


# Steps on texts that hold their markup, against texts written without it.
_NOISE_STEPS = {"e7_placeholders": mk.placeholders, "e11_web_links": mk.drop_http_links, "e12_bold_italic": mk.bold_italic,
                "e14_code_points": mk.numeric_entities, "e15_loose_spacing": mk.fix_spacing}


def _register_noise(name: str, text: str, plain: str) -> None:
    @register(name, f"select {kg.CUST} as title, {plain} as text from customer")
    def query(spark, sf):
        c = spark.read.parquet(f"{sf}/customer.parquet")
        c = c.select(F.expr(kg.CUST).alias("title"), F.expr(text).alias("text"))
        if name == "e10_malformed_links":
            return _without_links(c)
        return c.select("title", _NOISE_STEPS[name](F.col("text")).alias("text"))


for _noise in kg.MARKUP_NOISE:
    _register_noise(*_noise)


_KEEP_LINE = (
    "list_filter(list_transform(string_split(text, chr(10)), "
    "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '' "
    "and not starts_with(l, '++') and not starts_with(l, '==') "
    "and not (right(l, 1) = ':' or left(l, 1) in ('*', '#', ':', ';')) "
    "and not (left(l, 1) in ('{', '|') or right(l, 1) = '}') "
    "and not ((left(l, 1) = '(' and right(l, 1) = ')') or regexp_full_match(l, '[.\\-]*')) "
    "and not (not contains(l, '_') and len(regexp_split_to_array(l, '\\s+')) < 6))")


@register("e16_compact_lines",
          f"select doc_id, array_to_string({_KEEP_LINE}, chr(10)) as text from documents")
def e16(spark, sf):
    return _docs(spark, sf).select("doc_id", mk.compact(F.col("text")).alias("text"))


@register("e21_delete_chars", "select doc_id, translate(text, '=;*', '') as text from documents")
def e21(spark, sf):
    return _docs(spark, sf).select("doc_id", mk.delete_chars(F.col("text")).alias("text"))


@register("e23_first_lines",
          "select doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) as text "
          "from documents")
def e23(spark, sf):
    return _docs(spark, sf).select("doc_id", mk.first_lines(F.col("text"), 10).alias("text"))


@register("e22_clean_articles", with_kg(
    "select {t} as title, ".format(t=kg.CUST) + " || chr(10) || ".join(kg.EXPECTED_CLEAN_LINES)
    + " as text, cast(4 as bigint) as n_links from customer"))
def e22(spark, sf):
    c = tx.clean_articles(kg.articles(spark, sf))
    return c.select("title", "text", F.size("links").cast("bigint").alias("n_links"))


@register("e18_link_dictionary", with_kg(
    f"select {kg.CUST} as title, {kg.HOME} as token, {kg.HOME} as title_token from customer "
    f"union all select {kg.CUST}, {kg.DISTRACTOR}, {kg.DISTRACTOR} from customer"))
def e18(spark, sf):
    t, ty = _graph(spark, sf)
    c = tx.clean_articles(kg.articles(spark, sf))
    d = tx.link_dictionary(c, cat.build_catalog(ty, kg.CATALOG_TYPES))
    return d.select("title", F.explode("links_map").alias("token", "title_token"))


# --- F: sentences, tokens, values -------------------------------------------------

_SENTS_DUCK = (
    "with l as (select doc_id, list_filter(list_transform(flatten(list_transform("
    "string_split(text, chr(10)), lambda x: regexp_extract_all(x, '" + _SENTENCE + "', 0))), "
    "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as ss from documents), "
    "u as (select doc_id, unnest(range(len(ss))) as sent_id, unnest(ss) as sentence from l) "
    "select doc_id, cast(sent_id as int) as sent_id, array_to_string(regexp_extract_all(sentence, '"
    + tx.TOKEN_RE + "', 0), ' ') as tokens, cast(len(regexp_extract_all(sentence, '"
    + tx.TOKEN_RE + "', 0)) as bigint) as n_tokens from u")


@register("f1_sentences_tokens", _SENTS_DUCK)
def f1(spark, sf):
    s = tx.sentences(_docs(spark, sf), id_col="doc_id")
    return s.select("doc_id", F.col("sent_id").cast("int").alias("sent_id"),
                    F.array_join("tokens", " ").alias("tokens"),
                    F.size("tokens").cast("bigint").alias("n_tokens"))


@register("f4_numeric_words", f"""
select doc_id, cast(count(*) as bigint) as n_words,
 cast(count(*) filter (where regexp_full_match(w, '{vals.NUMERIC_RE.strip('^$')}')) as bigint) as n_numeric
from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) as w from documents) where w <> ''
group by doc_id""")
def f4(spark, sf):
    w = _docs(spark, sf).select("doc_id", F.explode(F.split("text", r"\s+")).alias("w")) \
        .where(F.col("w") != "")
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_words"),
        F.count(F.when(vals.is_numeric(F.col("w")), 1)).cast("bigint").alias("n_numeric"))


_F12_DUCK = """
with b as (select s, o, case when contains(o, 'tys') then 1000 when contains(o, 'mln') then 1000000 else 1 end as mult,
  regexp_extract(regexp_replace(o, '\\d{4} Census', '', 'g'), '([0-9., ]+)', 1) as run
  from kg_facts where p = 'balance'),
c as (select *, try_cast(replace(regexp_replace(run, '[^0-9,]', '', 'g'), ',', '.') as double) as prim,
  list_filter(string_split(run, ' '), lambda x: try_cast(replace(x, ',', '.') as double) is not null
     and regexp_full_match(trim(replace(x, ',', '.')), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')) as parts
  from b)
select s, o, coalesce(cast(trunc(prim * mult) as bigint),
   cast(trunc(try_cast(replace(parts[1], ',', '.') as double)) as bigint)) as value from c"""


@register("f12_numeric_values", with_kg(_F12_DUCK))
def f12(spark, sf):
    t, _ = _graph(spark, sf)
    b = t.where(F.col("p") == "balance").select("s", "o", vals.prepare_numeric(F.col("o")).alias("v"))
    return b.select("s", "o", F.get("v", 0).cast("bigint").alias("value"))


def _f13_duck() -> str:
    from ..config import GENERIC_VALUE_WORDS
    from ..sources.stopwords import default_stop_words
    stop = sql_list(default_stop_words())
    gen = sql_list(GENERIC_VALUE_WORDS)
    return with_kg(f"""
with v as (select s, p, o, regexp_replace(o, '\\dpx', '', 'g') as v from kg_facts
           where p in ('nation', 'region', 'brand', 'segment')),
t as (select *, regexp_extract_all(v, '(\\p{{L}}+)', 1) as toks from v)
select s, p, o, array_to_string(list_filter(case when len(toks) > 1 then list_concat(toks, [v]) else toks end,
  lambda x: octet_length(encode(x)) > 1 and not list_contains({stop}, x) and not list_contains({gen}, x)), '|') as vals
from t""")


@register("f13_text_values", _f13_duck())
def f13(spark, sf):
    t, _ = _graph(spark, sf)
    f = t.where(F.col("p").isin("nation", "region", "brand", "segment"))
    return f.select("s", "p", "o", F.array_join(vals.prepare_text(F.col("o")), "|").alias("vals"))


@register("f17_relation_words", with_kg(
    "select p, array_to_string(list_filter(list_transform(string_split("
    "regexp_replace(p, '(\\p{Lu})', ' \\1', 'g'), ' '), lambda x: lower(x)), lambda x: x <> ''), ' ') as words "
    "from (select distinct p from kg_triples)"))
def f17(spark, sf):
    t, _ = _graph(spark, sf)
    return t.select("p").distinct().select("p", F.array_join(tg.relation_words(F.col("p")), " ").alias("words"))


# --- G, I, J on the prepared article sentences ------------------------------------
# The oracle builds each derived article's expected cleaned sentences from the
# source columns and tokenises / true-cases / labels them in SQL, so these
# checks cover the Spark chain clean -> split -> tag -> label -> decode.


_PLANTED = ["nation", "balance"]


def _corpus_sentences(spark, sf, persist=False):
    from .jobs import prepare_corpus
    t, ty = _graph(spark, sf)
    catalog = cat.build_catalog(ty, kg.CATALOG_TYPES)
    return t, ty, catalog, prepare_corpus(kg.articles(spark, sf), catalog, persist=persist)


def _labelled(spark, sf):
    """Sentences of all pairs: the bound on training pairs is for fits."""
    t, ty, catalog, sents = _corpus_sentences(spark, sf, persist=True)      # read once a relation
    ge, _ = kg.gold(spark, sf)
    parts = []
    for p in _PLANTED:
        spec = kg.relation(p)
        pairs = sup.drop_gold(sup.training_pairs(t, ty, spec, limit=None), ge.where(F.col("p") == p))
        parts.append(sup.label_sentences(pairs, sents, spec).withColumn("p", F.lit(p)))
    lab = parts[0].unionByName(parts[1])
    return t, ty, catalog, lab


def _positives(lab):
    parts = [sup.best_positives(lab.where(F.col("p") == p)).withColumn("p", F.lit(p)) for p in _PLANTED]
    return parts[0].unionByName(parts[1])


@register("f11_prepared_sentences", with_kg(f"""with {sentences_ctes()}
select title, cast(sent_id as int) as sent_id, array_to_string(lemmas, ' ') as lemmas,
       array_to_string(segments, ' ') as segments from kg_sent"""))
def f11(spark, sf):
    _, _, _, s = _corpus_sentences(spark, sf)
    return s.select("title", F.col("sent_id").cast("int").alias("sent_id"),
                    F.array_join(F.transform("words", lambda w: w["lemma"]), " ").alias("lemmas"),
                    F.array_join(F.transform("words", lambda w: w["segment"]), " ").alias("segments"))


@register("g1_training_pairs", with_kg(f"with {pairs_ctes(TRAINING_LIMIT)} select p, s, o from kg_pairs"))
def g1(spark, sf):
    t, ty = _graph(spark, sf)
    ge, _ = kg.gold(spark, sf)
    parts = [sup.drop_gold(sup.training_pairs(t, ty, kg.relation(p)), ge.where(F.col("p") == p))
             .select(F.lit(p).alias("p"), "s", "o") for p in _PLANTED]
    return parts[0].unionByName(parts[1])


@register("g5_label_sentences", with_kg(f"""with {labelled_ctes()}
select p, s, o, cast(sent_id as int) as sent_id, kind, n_match from kg_lab"""))
def g5(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    return lab.select("p", "s", "o", F.col("sent_id").cast("int").alias("sent_id"), "kind",
                      F.col("n_match").cast("bigint").alias("n_match"))


@register("g6_best_positive", with_kg(f"""with {labelled_ctes()}
select p, s, o, cast(sent_id as int) as sent_id from kg_pos"""))
def g6(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    return _positives(lab).select("p", "s", "o", F.col("sent_id").cast("int").alias("sent_id"))


@register("g9_undersample", with_kg(f"""with {labelled_ctes()},
npos as (select p, count(*) as n from kg_pos group by p),
neg as (select l.p, l.s, l.o, l.sent_id, row_number() over (partition by l.p order by
        md5(concat_ws('|', l.s, l.o, cast(l.sent_id as varchar), '7'))) as rn from kg_lab l where kind = 'neg')
select neg.p, s, o, cast(sent_id as int) as sent_id from neg join npos on neg.p = npos.p where rn <= npos.n"""))
def g9(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    lab = stage_table(lab, "labelled")      # the selection reads it several times
    pos = _positives(lab)
    parts = []
    for p in _PLANTED:
        n = pos.where(F.col("p") == p).count()
        parts.append(sup.undersample(sup.negatives(lab.where(F.col("p") == p)), n)
                     .select(F.lit(p).alias("p"), "s", "o", F.col("sent_id").cast("int").alias("sent_id")))
    return parts[0].unionByName(parts[1])


_CURVE_SEEDS = [0, 1, 2]


@register("j6_learning_samples", with_kg(f"""with {labelled_ctes()},
seeds as (select unnest({_CURVE_SEEDS}) as seed), caps as (select unnest({LEARNING_CURVE_CAPS}) as cap),
r as (select p, seed, s, o, sent_id, row_number() over (partition by p, seed
  order by md5(concat_ws('|', s, o, cast(seed as varchar)))) as rank from kg_pos, seeds)
select p, cast(cap as int) as cap, cast(seed as int) as seed, s, o, cast(sent_id as int) as sent_id from r join caps on rank <= cap"""))
def j6(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    pos = stage_table(_positives(lab), "positives")      # the selection reads it several times
    parts = [sup.nested_samples(pos.where(F.col("p") == p), LEARNING_CURVE_CAPS, _CURVE_SEEDS) for p in _PLANTED]
    return parts[0].unionByName(parts[1]).select("p", "cap", "seed", "s", "o", F.col("sent_id").cast("int").alias("sent_id"))


def _stop_sql():
    from ..sources.stopwords import default_stop_words
    return sql_list(default_stop_words())


@register("g10_vocabulary", with_kg(f"""with {labelled_ctes()},
f as (select p, unnest(list_filter(lemmas, lambda l: regexp_matches(l, '^\\p{{Ll}}')
        and not list_contains({_stop_sql()}, l))) as feature from kg_posrows)
select p, feature, cast(count(*) as bigint) as n from f group by p, feature having count(*) > 2"""))
def g10(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    pos = _positives(lab)
    parts = [sup.vocabulary(pos.where(F.col("p") == p), 2).select(
        F.lit(p).alias("p"), "feature", F.col("n").cast("bigint").alias("n")) for p in _PLANTED]
    return parts[0].unionByName(parts[1])


_LABELS_SQL = ("list_transform(range(len(lemmas)), lambda i: case when list_contains("
               "list_transform(vals, lambda v: lower(v)), lower(lemmas[i + 1])) or list_contains("
               "list_transform(vals, lambda v: lower(v)), lower(segments[i + 1])) then 1 else 0 end)")


@register("i3_token_labels", with_kg(f"""with {labelled_ctes()}
select p, s, cast(sent_id as int) as sent_id,
       array_to_string(list_transform({_LABELS_SQL}, lambda x: cast(x as varchar)), ' ') as labels
from kg_posrows"""))
def i3(spark, sf):
    _, _, _, lab = _labelled(spark, sf)
    pos = _positives(lab)
    lab_col = ex.token_labels(F.col("words"), F.col("values"))
    return pos.select("p", "s", F.col("sent_id").cast("int").alias("sent_id"),
                      F.array_join(F.transform(lab_col, lambda x: x.cast("string")), " ").alias("labels"))


def _decoded(spark, sf):
    """I7-I14 on given tags: the positives' token labels with p = 1."""
    t, ty, catalog, lab = _labelled(spark, sf)
    pos = stage_table(_positives(lab), "positives")      # decoded, and the gold of the scores
    out = []
    for p in _PLANTED:
        spec = kg.relation(p)
        tagged = pos.where(F.col("p") == p).select(
            F.col("s").alias("entity"), "sent_id", "words",
            ex.token_labels(F.col("words"), F.col("values")).alias("tags"),
            F.array_repeat(F.lit(1.0), F.size("words")).alias("probs"))
        spans = ex.spans(tagged, spec)
        ot = cat.predominant_types(t, ty, spec, subject=False)
        out.append(ex.select_values(spans, spec, catalog, ot).select(F.lit(p).alias("p"), "entity", "value"))
    return out[0].unionByName(out[1]), pos


_DECODE_SQL = f"""{labelled_ctes()},
tk as (select p, s as entity, sent_id, unnest(lemmas) as lemma, unnest(range(len(lemmas))) as pos,
       unnest({_LABELS_SQL}) as tag from kg_posrows),
tk2 as (select *, case when lemma = '-' then 1 else tag end as t2 from tk),
isl as (select *, sum(case when t2 = 1 then 0 else 1 end) over (partition by p, entity, sent_id order by pos) as run from tk2),
runs as (select p, entity, sent_id, run, list(lemma order by pos) as lem, min(pos) filter (where lemma <> '-') as start
         from isl where t2 = 1 group by p, entity, sent_id, run),
trimmed as (select p, entity, sent_id, start,
   list_slice(lem, list_position(list_transform(lem, lambda x: x <> '-'), true), len(lem)) as l1 from runs
   where list_position(list_transform(lem, lambda x: x <> '-'), true) is not null),
trimmed2 as (select p, entity, sent_id, start,
   case when l1[len(l1)] = '-' then list_slice(l1, 1, len(l1) - 1) else l1 end as l2 from trimmed),
vals as (select p, entity, sent_id, start, replace(array_to_string(l2, '_'), '_-_', '-') as v from trimmed2 where len(l2) > 0),
pref as (select * from vals where left(v, 4) <> left(entity, 4)),
norm as (select p, entity, sent_id, start,
   case when regexp_full_match(v, '\\s*[+-]?(\\d+([.,]\\d*)?|[.,]\\d+)([eE][+-]?\\d+)?\\s*')
        then cast(cast(trunc(cast(replace(v, ',', '.') as double)) as bigint) as varchar)
        when contains(v, '_') then upper(left(v, 1)) || substr(v, 2) else v end as value from pref),
ot as ({_predominant_sql('nation', 'object')}),
cat as (select name, type from (select entity as name, type from kg_types where type in
        {_CAT.replace('[', '(').replace(']', ')')} union all select split_part(entity, '_(', 1) as name, type
        from kg_types where type in {_CAT.replace('[', '(').replace(']', ')')} and contains(entity, '_('))),
pri as (select n.*, case when n.p = 'balance' then 0
   when exists (select 1 from cat c join ot on c.type = ot.type where c.name = n.value) then 2
   when exists (select 1 from cat c where c.name = n.value) then 1 else -1 end as prio from norm n),
best as (select p, entity, arg_max(value, prio * 1000000000 - sent_id * 1000 - start) as value
         from pri where prio >= 0 group by p, entity)"""


@register("i8_decode_given_tags", with_kg(f"with {_DECODE_SQL} select p, entity, value from best"))
def i8(spark, sf):
    return _decoded(spark, sf)[0]


@register("j3_extractor_fit_scores", with_kg(f"""with {_DECODE_SQL},
gold as (select p, s as entity, vals from kg_pairs where s in (select s from kg_pos where kg_pos.p = kg_pairs.p)),
j as (select coalesce(g.p, b.p) as p, g.vals, b.value from gold g full outer join best b
      on g.p = b.p and g.entity = b.entity),
c as (select p,
   (value is not null and vals is not null and coalesce(list_contains(vals, value), false)) as tp,
   (value is not null and not (vals is not null and coalesce(list_contains(vals, value), false))) as fp,
   (vals is not null and not (value is not null and coalesce(list_contains(vals, value), false))) as fn
   from j)
select p, cast(count(*) filter (where tp) as bigint) as tp, cast(count(*) filter (where fp) as bigint) as fp,
       cast(count(*) filter (where fn) as bigint) as fn,
       count(*) filter (where tp) / greatest(count(*) filter (where tp) + count(*) filter (where fp), 1) as precision,
       count(*) filter (where tp) / greatest(count(*) filter (where tp) + count(*) filter (where fn), 1) as recall
from c group by p"""))
def j3(spark, sf):
    dec, pos = _decoded(spark, sf)
    out = []
    for p in _PLANTED:
        gold = pos.where(F.col("p") == p).select(F.col("s").alias("entity"), F.col("values"))
        pred = dec.where(F.col("p") == p).select("entity", "value")
        sc = ev.scores(ev.classify_errors(gold, pred), p)
        out.append(sc.select("p", "tp", "fp", "fn", "precision", "recall"))
    return out[0].unionByName(out[1])


@register("j5_error_table", with_kg(f"""with {_DECODE_SQL},
gold as (select p, s as entity, vals from kg_pairs where s in (select s from kg_pos where kg_pos.p = kg_pairs.p)),
odd as (select p, entity, case when ascii(right(entity, 1)) % 4 = 0 then 'wrong' else value end as value from best
  where ascii(right(entity, 1)) % 4 <> 1),
j as (select coalesce(g.p, b.p) as p, coalesce(g.entity, b.entity) as entity, g.vals, b.value from gold g full outer join odd b
      on g.p = b.p and g.entity = b.entity)
select p, entity, coalesce(array_to_string(vals, ', '), '-') as gold, coalesce(value, '-') as extracted,
  case when value is null then 'FN' when coalesce(list_contains(vals, value), false) then '' else 'FP/FN' end as error from j"""))
def j5(spark, sf):
    """The decoded values, of which some are spoilt and some left out, against the pairs."""
    dec, pos = _decoded(spark, sf)
    last = F.ascii(F.right("entity", F.lit(1))) % 4
    dec = dec.where(last != 1).withColumn("value", F.when(last == 0, "wrong").otherwise(F.col("value")))
    out = []
    for p in _PLANTED:
        gold = pos.where(F.col("p") == p).select(F.col("s").alias("entity"), F.col("values"))
        c = ev.classify_errors(gold, dec.where(F.col("p") == p).select("entity", "value"))
        out.append(ev.error_table(c).select(F.lit(p).alias("p"), "entity", "gold", "extracted", "error"))
    return out[0].unionByName(out[1])


@register("a3_a4_requested_articles", with_kg(f"""with {sentences_ctes()},
names as (select distinct replace(c_name, '#', '_') as title from customer where c_custkey % 4 = 0
  union select 'Nobody_' || c_nationkey from customer)
select n.title, cast(coalesce(s.sent_id, -1) as int) as sent_id, coalesce(array_to_string(s.lemmas, ' '), '') as lemmas
from names n left join kg_sent s on s.title = n.title and s.sent_id < 2"""))
def a3(spark, sf):
    """The first two sentences of requested articles, and the names without an article."""
    _, _, _, sents = _corpus_sentences(spark, sf)
    c = spark.read.parquet(f"{sf}/customer.parquet")
    names = c.where("c_custkey % 4 = 0").select(F.expr(kg.CUST).alias("name")) \
        .union(c.select(F.concat(F.lit("Nobody_"), "c_nationkey")))
    _, missing = dump.requested(kg.articles(spark, sf), names)
    got = tx.get_articles(sents, names, sentence_limit=2)
    return got.select("title", F.col("sent_id").cast("int").alias("sent_id"),
                      F.array_join(F.transform("words", lambda w: w["lemma"]), " ").alias("lemmas")) \
        .unionByName(missing.select("title", F.lit(-1).alias("sent_id"), F.lit("").alias("lemmas")))


# --- A, B: sources and sinks (write to the stage folder, read back) ------------------



def _key(sf: str) -> str:
    import hashlib
    return hashlib.md5(sf.encode()).hexdigest()[:12]


@register("b1_ntriples_lines", with_kg(f"""
select '<{iri.DATA_SOURCE}/resource/' || replace(url_encode(s), '%2F', '/') ||
       '> <{iri.DATA_SOURCE}/property/nation> "' || o || '"@pl .' as value
from (select distinct s, o from kg_facts where p = 'nation')"""))
def b1(spark, sf):
    t, _ = _graph(spark, sf)
    f = t.where(F.col("p") == "nation").select(F.col("s").alias("entity"), F.col("o").alias("value"))
    return nt.ntriple_lines(f, "nation", numeric=False)


@register("a5_ntriples_roundtrip", with_kg(
    "select s, p, o, 'literal' as o_kind, 'pl' as lang from kg_facts where p = 'nation'"))
def a5(spark, sf):
    path = stage_path(spark, f"a5_ntriples_{_key(sf)}")
    b1(spark, sf).write.mode("overwrite").text(path)
    return nt.read_ntriples(spark, path).select("s", "p", "o", "o_kind", "lang")


@register("a11_gold_roundtrip", with_kg(
    "select p, entity, array_to_string(\"values\", ' ') as vals from kg_gold_values"))
def a11(spark, sf):
    root = stage_path(spark, f"a11_gold_{_key(sf)}")
    ge, gv = kg.gold(spark, sf)
    gold_io.write_gold(ge, gv, root)
    _, vals = gold_io.read_gold(spark, root)
    return vals.select("p", "entity", F.array_join("values", " ").alias("vals"))


@register("j7_evaluation_sample", with_kg("""
with pairs as (select s, o from kg_facts where p = 'nation'),
smp as (select s, o from pairs order by md5(concat_ws('|', s, o, '1')) limit 100)
select s as entity, array_to_string(list_sort(list(o)), ' ') as vals from smp
where s in (select title from kg_articles) group by s"""))
def j7(spark, sf):
    t, _ = _graph(spark, sf)
    pairs = t.where(F.col("p") == "nation").select("s", "o")
    smp = ev.evaluation_sample(pairs, kg.articles(spark, sf), n=100, seed=1)
    return smp.select("entity", F.array_join(F.array_sort("values"), " ").alias("vals"))


@register("d2_is_entity", with_kg(f"""with {sentences_ctes()},
catn as (select distinct name from (select entity as name from kg_types where type in
        {_CAT.replace('[', '(').replace(']', ')')} union all select split_part(entity, '_(', 1) from kg_types
        where type in {_CAT.replace('[', '(').replace(']', ')')} and contains(entity, '_('))),
w as (select title, sent_id, unnest(segments) as seg from kg_sent)
select title, cast(sent_id as int) as sent_id, cast(count(*) filter (where seg in (select name from catn)) as bigint) as n_entities,
       cast(count(*) as bigint) as n_words from w group by title, sent_id"""))
def d2(spark, sf):
    _, _, catalog, sents = _corpus_sentences(spark, sf)
    toks = sents.select("title", "sent_id", F.explode(F.transform("words", lambda w: w["segment"])).alias("seg"))
    flagged = cat.is_entity(toks, "seg", catalog)
    return flagged.groupBy("title", F.col("sent_id").cast("int").alias("sent_id")).agg(
        F.count(F.when(F.col("is_entity"), 1)).cast("bigint").alias("n_entities"),
        F.count(F.lit(1)).cast("bigint").alias("n_words"))


@register("k4_paper_labels", with_kg(f"""with {labelled_ctes()},
m as (select *, sum(case when kind = 'pos' then 1 else 0 end) over (partition by p, s, o) as nm,
      list_contains(lemmas, p) as has_word from kg_lab where p = 'nation')
select s, o, cast(sent_id as int) as sent_id,
       case when kind = 'pos' and (nm = 1 or has_word) then 'pos' when kind = 'neg' then 'neg' else 'none' end as kind
from m"""))
def k4(spark, sf):
    t, ty, _, sents = _corpus_sentences(spark, sf)
    ge, _ = kg.gold(spark, sf)
    spec = kg.relation("nation")
    pairs = sup.drop_gold(sup.training_pairs(t, ty, spec, limit=None), ge.where(F.col("p") == "nation"))
    lab = paper.label_sentences_paper(pairs, sents, spec)
    return lab.select("s", "o", F.col("sent_id").cast("int").alias("sent_id"), "kind")


_DUMP_SQL = "pg as (" + " union all ".join(
    f"select {t} as title, {i} as page_id, {x} as wikitext, {o} as place from customer where {w}"
    for t, i, x, o, w in kg.DUMP_PAGES) + ")"
_IN_CATALOG = "c_custkey % 3 <> 1"


def _dump(spark, sf):
    path = stage_path(spark, f"dump_{_key(sf)}")
    dump.write_dump(kg.dump_pages(spark, sf), path, "place", files=6)
    return path


@register("a1_p3_dump_articles", with_kg(f"""with {_DUMP_SQL},
names as (select {kg.CUST} as name from customer where {_IN_CATALOG}
  union all select replace({kg.CUST}, '_', '/') from customer where {_IN_CATALOG}),
kept as (select *, replace(title, '/', '_') as stored_name from pg where title in (select name from names)),
best as (select stored_name, max(place) as place from kept group by stored_name)
select k.title, k.page_id, k.stored_name, md5(k.wikitext) as text_md5
from kept k join best b on k.stored_name = b.stored_name and k.place = b.place"""))
def a1(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").where(_IN_CATALOG).select(F.expr(kg.CUST).alias("name"))
    names = c.union(c.select(F.replace("name", F.lit("_"), F.lit("/"))))
    arts = dump.prepare_corpus_from_dump(spark, _dump(spark, sf), names, partitions=5)
    return arts.select("title", "page_id", "stored_name", F.md5("wikitext").alias("text_md5"))


_FILE_BYTES = 20000


@register("a2_b3_b4_p4_plain_corpus", with_kg(f"""with rec as (select c_custkey as page_id,
  '<doc id="' || c_custkey || '" url="http://pl.wikipedia.org/wiki/' || {kg.CUST} || '">' || chr(10) || {" || chr(10) || ".join(kg.EXPECTED_CLEAN_LINES)}
  || chr(10) || '</doc>' || chr(10) as value from customer),
pl as (select *, cast(sum(strlen(value)) over (order by page_id) - strlen(value) as bigint) // {_FILE_BYTES} as file from rec)
select file // 100 as folder, file, cast(count(*) as bigint) as n_docs, cast(sum(strlen(value)) as bigint) as n_bytes,
  md5(string_agg(value, '' order by page_id)) as text_md5 from pl group by file"""))
def p4(spark, sf):
    path = _dump(spark, sf)
    dump.plain_corpus(dump.read_dump(spark, path), f"{path}-text", max_bytes=_FILE_BYTES, compress=True)
    c = dump.read_corpus(spark, f"{path}-text")
    return c.select(F.col("folder").cast("bigint").alias("folder"), F.col("file").cast("bigint").alias("file"),
                    F.regexp_count("value", F.lit("</doc>")).cast("bigint").alias("n_docs"),
                    F.octet_length("value").cast("bigint").alias("n_bytes"), F.md5("value").alias("text_md5"))


# --- F15, F16, F18, K1, K2 ---------------------------------------------------------------

_HYPER_SQL = " union ".join(f"select {s} as synset, {o} as parent from {t}" for t, s, o in kg.HYPERNYMS)


@register("f16_hypernym_closure", f"""
with recursive h as ({_HYPER_SQL}),
c(synset, ancestor, depth) as (select synset, parent, 1 from h
  union select c.synset, h.parent, c.depth + 1 from c join h on c.ancestor = h.synset)
select synset, ancestor, cast(min(depth) as int) as depth from c group by synset, ancestor""")
def f16(spark, sf):
    return senses.hypernym_closure(kg.hypernyms(spark, sf))


@register("f15_first_senses", with_kg(f"""with {sentences_ctes()},
w as (select title, sent_id, pos, lemma from kg_words),
sn as (select distinct {kg.SENSES[1]} as lemma, {kg.SENSES[2]} as pos, {kg.SENSES[3]} as rank, {kg.SENSES[4]} as synset
  from {kg.SENSES[0]}),
best as (select lemma, arg_min(synset, rank * 10 + case when pos = 'n' then 0 else 1 end) as synset from sn group by lemma)
select title, cast(sent_id as int) as sent_id, string_agg(coalesce(synset, ''), ' ' order by w.pos) as synsets
from w left join best on w.lemma = best.lemma group by title, sent_id"""))
def f15(spark, sf):
    _, _, _, sents = _corpus_sentences(spark, sf, persist=True)
    return senses.with_synsets(sents, kg.senses(spark, sf)).select(
        "title", F.col("sent_id").cast("int").alias("sent_id"), F.array_join("synsets", " ").alias("synsets"))


@register("f18_incremental_articles", with_kg(f"""with {sentences_ctes()}
select title, cast(sent_id as int) as sent_id, array_to_string(lemmas, ' ') as lemmas,
       array_to_string(segments, ' ') as segments from kg_sent"""))
def f18(spark, sf):
    """Two runs of the stream: the articles arrive in six files, three a run, two a batch."""
    root = stage_path(spark, f"f18_{_key(sf)}")
    t, ty = _graph(spark, sf)
    catalog = cat.build_catalog(ty, kg.CATALOG_TYPES)
    raw = kg.articles(spark, sf).select("title", F.col("page_id").cast("long").alias("page_id"), "wikitext")
    for half in (0, 1):
        raw.where(F.col("page_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{root}/raw")
        incremental.prepare_stream(spark, f"{root}/raw", f"{root}/out", catalog,
                                   query_name=f"f18_{root.split('/')[-2]}", max_files=2)
    s = incremental.read_sentences(spark, f"{root}/out")
    return s.select("title", F.col("sent_id").cast("int").alias("sent_id"),
                    F.array_join(F.transform("words", lambda w: w["lemma"]), " ").alias("lemmas"),
                    F.array_join(F.transform("words", lambda w: w["segment"]), " ").alias("segments"))


@register("a12_b10_stage_cache", ORACLE["f18_incremental_articles"])
def a12(spark, sf):
    """The prepared sentences, made by a first call and read by a second."""
    from . import jobs
    root = stage_path(spark, f"a12_{_key(sf)}")
    t, ty = _graph(spark, sf)
    catalog = cat.build_catalog(ty, kg.CATALOG_TYPES)
    kg.articles(spark, sf).write.parquet(f"{root}/articles")
    jobs.cached_corpus(spark, f"{root}/articles", catalog, f"{root}/cache")
    s = jobs.cached_corpus(spark, f"{root}/articles", catalog, f"{root}/cache")
    return s.select("title", F.col("sent_id").cast("int").alias("sent_id"),
                    F.array_join(F.transform("words", lambda w: w["lemma"]), " ").alias("lemmas"),
                    F.array_join(F.transform("words", lambda w: w["segment"]), " ").alias("segments"))


# Names of several parts for K1: two to four words that follow each other in the articles.
_NAMES_SQL = f"""select 'a_small_' || {kg.SEG} as name from customer union select 'regular_orders' from customer
  union select 'home_nation' from customer union select 'home_nation_is_' || {kg.HOME} from customer
  union select {kg.SEG} || '_customer' from customer union select {kg.SEG} || '_division_since_' || {kg.YEAR} from customer
  union select 'Its_largest_supplier' from customer union select 'largest_supplier_ships_goods' from customer
  union select 'nation_is' from customer"""


@register("k1_joined_names", with_kg(f"""with recursive {sentences_ctes()},
names as (select name, string_split(name, '_') as parts from ({_NAMES_SQL})),
hits as (select s.title, s.sent_id, u.i, max(len(n.parts)) as k from kg_sent s, unnest(range(len(s.segments))) as u(i)
  join names n on n.parts[1] = s.segments[u.i + 1] and list_slice(s.segments, u.i + 1, u.i + len(n.parts)) = n.parts
  group by s.title, s.sent_id, u.i),
walk(title, sent_id, i, out) as (select title, sent_id, cast(0 as bigint), []::varchar[] from kg_sent
  union all select w.title, w.sent_id, w.i + coalesce(a.k, 1),
    list_append(w.out, array_to_string(list_slice(s.segments, w.i + 1, w.i + coalesce(a.k, 1)), '_'))
  from walk w join kg_sent s on w.title = s.title and w.sent_id = s.sent_id and w.i < len(s.segments)
  left join hits a on a.title = w.title and a.sent_id = w.sent_id and a.i = w.i)
select w.title, cast(w.sent_id as int) as sent_id, array_to_string(w.out, ' ') as segments
from walk w join kg_sent s on w.title = s.title and w.sent_id = s.sent_id and w.i = len(s.segments)"""))
def k1(spark, sf):
    _, _, _, sents = _corpus_sentences(spark, sf, persist=True)
    c = spark.read.parquet(f"{sf}/customer.parquet")
    exprs = [x.strip().removeprefix("select ").removesuffix(" from customer").removesuffix(" as name")
             for x in _NAMES_SQL.split(" union ")]
    names = c.select(F.explode(F.array(*[F.expr(e) for e in exprs])).alias("name")).distinct()
    return paper.join_names(sents, names).select(
        "title", F.col("sent_id").cast("int").alias("sent_id"),
        F.array_join(F.transform("words", lambda w: w["segment"]), " ").alias("segments"))


_REDIRECT_SQL = " union all ".join(f"select {t} as title, {i} as page_id, {to} as target from customer where {w}"
                                   for t, i, to, w in kg.REDIRECT_PAGES)


@register("k2_canonical_names", with_kg(f"""with recursive
r as (select replace(title, ' ', '_') as name, arg_max(replace(target, ' ', '_'), page_id) as canonical
  from ({_REDIRECT_SQL}) group by replace(title, ' ', '_')),
one as (select name, canonical from r),
w(name, cur, path) as (select name, canonical, [name] from one
  union all select w.name, o.canonical, list_append(w.path, w.cur) from w join one o on o.name = w.cur
  where not list_contains(w.path, w.cur)),
ends as (select name, case when list_contains(path, cur) then list_min(list_slice(path, list_position(path, cur), len(path)))
    else cur end as canonical from w where list_contains(path, cur) or cur not in (select name from one)),
f as (select s, o from kg_facts where p = 'customer')
select f.s, coalesce(e.canonical, f.o) as o from f left join ends e on e.name = f.o"""))
def k2(spark, sf):
    """The customer of every order under its canonical name."""
    t, _ = _graph(spark, sf)
    table = paper.resolve_redirects(paper.redirects(kg.redirect_pages(spark, sf)))
    return paper.canonical_names(t.where(F.col("p") == "customer").select("s", "o"), "o", table)


# --- trained stages: rows-only checks (numbers are not portable) ----------------------

def _trained(spark, sf, p="nation"):
    from .jobs import Corpus, train_models
    t, ty, catalog, sents = _corpus_sentences(spark, sf, persist=True)
    ge, gv = kg.gold(spark, sf)
    c = Corpus(t, ty, catalog, sents, ge, gv)
    return c, train_models(c, kg.relation(p))


@register("h4_informative_features")
def h4(spark, sf):
    from ..operators import classify
    _, m = _trained(spark, sf)
    return classify.most_informative(m.classifier, spark)


@register("h5_i6_p2_evaluate")
def p2(spark, sf):
    from .jobs import evaluate_relation
    c, m = _trained(spark, sf)
    s, _, _ = evaluate_relation(c, kg.relation("nation"), m)
    return s


@register("p1_enrich_ntriples")
def p1(spark, sf):
    from .jobs import enrich
    c, m = _trained(spark, sf, "balance")
    return enrich(c, kg.relation("balance"), m)


@register("i5_crf_informative_features")
def i5(spark, sf):
    from ..operators import crf
    _, m = _trained(spark, sf)
    return crf.most_informative(m.extractor, m.positives)
