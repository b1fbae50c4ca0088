"""DuckDB views of the test-data adapter, built from the same expression strings.

``with_kg(body)`` prefixes a query with CTEs ``kg_triples``, ``kg_types``,
``kg_facts``, ``kg_articles``, ``kg_gold_entities``, ``kg_gold_values`` over
the driver's pre-registered tables.
"""

from __future__ import annotations

import re

from . import testkg as kg

_SOURCES = {
    "nation": "(select * from nation left join (select r_regionkey, r_name as nr_name "
              "from region) rr on n_regionkey = rr.r_regionkey)",
    "lineitem_part": "(select l_orderkey, l_partkey, p_partkey, p_name from lineitem "
                     "join part on l_partkey = p_partkey)",
}


def triples_sql() -> str:
    parts = []
    for src, s, p, o, w in kg.TRIPLE_SOURCES:
        frm = _SOURCES.get(src, src)
        where = f" where {w}" if w else ""
        parts.append(f"select {s} as s, '{p}' as p, {o} as o from {frm} t{where}")
    return "\n union all ".join(parts)


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def with_kg(body: str) -> str:
    body = body.strip()
    start = "with"
    if head := re.match(r"with(\s+recursive)?\s", body, re.I):
        start, body = head[0].strip(), ", " + body[head.end():].strip()
    return f"""{start} kg_triples as ({triples_sql()}),
kg_types as (select s as entity, o as type from kg_triples where p = 'type'),
kg_facts as (select * from kg_triples where p <> 'type'),
kg_articles as (select {kg.CUST} as title, c_custkey as page_id, {kg.ARTICLE} as wikitext from customer),
kg_gold_entities as (
  select 'nation' as p, {kg.CUST} as entity from customer where c_custkey % 3 = 0
  union all select 'balance' as p, {kg.CUST} as entity from customer where c_custkey % 3 = 0),
kg_gold_values as (
  select 'nation' as p, {kg.CUST} as entity, [{kg.HOME}] as "values" from customer where c_custkey % 3 = 0
  union all select 'balance' as p, {kg.CUST} as entity, [cast({kg.BAL_INT} as string)] as "values"
  from customer where c_custkey % 3 = 0)
{body}"""


def f12_sql(col: str) -> str:
    """DuckDB form of the numeric value normaliser -> ``list<varchar>``."""
    run = (f"regexp_extract(regexp_replace({col}, '\\d{{4}} Census', '', 'g'), '([0-9., ]+)', 1)")
    mult = f"(case when contains({col}, 'tys') then 1000 when contains({col}, 'mln') then 1000000 else 1 end)"
    prim = f"try_cast(replace(regexp_replace({run}, '[^0-9,]', '', 'g'), ',', '.') as double)"
    parts = (f"list_filter(string_split({run}, ' '), lambda x: "
             "regexp_full_match(trim(replace(x, ',', '.')), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'))")
    val = (f"coalesce(cast(trunc({prim} * {mult}) as bigint), "
           f"cast(trunc(try_cast(replace({parts}[1], ',', '.') as double)) as bigint))")
    return f"(case when {val} is null then []::varchar[] else [cast({val} as varchar)] end)"


def f13_sql(col: str) -> str:
    """DuckDB form of the text value normaliser -> ``list<varchar>``."""
    from ..config import GENERIC_VALUE_WORDS
    from ..sources.stopwords import default_stop_words
    v = f"regexp_replace({col}, '\\dpx', '', 'g')"
    toks = f"regexp_extract_all({v}, '(\\p{{L}}+)', 1)"
    return (f"list_filter(case when len({toks}) > 1 then list_concat({toks}, [{v}]) else {toks} end, "
            f"lambda x: octet_length(encode(x)) > 1 and not list_contains({sql_list(default_stop_words())}, x) "
            f"and not list_contains({sql_list(GENERIC_VALUE_WORDS)}, x))")


def sentences_ctes() -> str:
    """Expected prepared sentences of the derived articles (built from the
    source columns, not by running a cleaner): ``kg_sent(title, sent_id,
    lemmas, segments)``."""
    from ..operators.text import TOKEN_RE
    lines = " union all ".join(
        f"select {kg.CUST} as title, {i} as sent_id, {e} as line from customer"
        for i, e in enumerate(kg.EXPECTED_SENTENCES))
    return f"""kg_lines as ({lines}),
kg_tok as (select title, sent_id, unnest(toks) as form, unnest(range(len(toks))) as pos
           from (select title, sent_id, regexp_extract_all(line, '{TOKEN_RE}', 0) as toks from kg_lines)),
kg_forms as (select distinct form from kg_tok),
kg_lex as (select f.form, coalesce(l.form, f.form) as lemma from kg_forms f
           left join kg_forms l on l.form = lower(f.form)),
kg_words as (select t.title, t.sent_id, t.pos, t.form as segment, x.lemma from kg_tok t join kg_lex x on t.form = x.form),
kg_sent as (select title, sent_id, list(lemma order by pos) as lemmas, list(segment order by pos) as segments
            from kg_words group by title, sent_id)"""


def pairs_ctes(limit: int | None = None) -> str:
    """Training pairs (G1-G4) for the two planted relations with prepared values:
    ``kg_pairs(p, s, o, vals)``; with a limit the first pair of every value by
    its md5, then the second, and so on."""
    cut = f" order by rank, h, s, o limit {limit}" if limit else ""

    def one(p, typed):
        src = (f"select f.s, f.o from kg_facts f join kg_types t on f.s = t.entity "
               f"where f.p = '{p}' and t.type = 'Customer'") if typed else \
            f"select s, o from kg_facts where p = '{p}'"
        return f"""pr_{p} as ({src}),
pl_{p} as (select s, o from (select s, o, md5(concat_ws('|', s, o)) as h,
  row_number() over (partition by o order by md5(concat_ws('|', s, o)), s) as rank from pr_{p}){cut}),
pg_{p} as (select s, o from pl_{p} where s not in (select entity from kg_gold_entities where p = '{p}'))"""
    return f"""{one('nation', False)},
{one('balance', True)},
kg_pairs as (select 'nation' as p, s, o, {f13_sql('o')} as vals from pg_nation
  union all select 'balance' as p, s, o, {f12_sql('o')} as vals from pg_balance)"""


def labelled_ctes() -> str:
    """G5-G6 on the expected sentences: ``kg_lab``, ``kg_pos``."""
    return f"""{sentences_ctes()},
{pairs_ctes()},
kg_lab as (select k.p, k.s, k.o, k.vals, t.sent_id, t.lemmas, t.segments,
  case when len(list_intersect(t.lemmas, k.vals)) > 0 then 'pos' else 'neg' end as kind,
  cast(len(list_intersect(t.lemmas, k.vals)) as bigint) as n_match
  from kg_pairs k join kg_sent t on t.title = k.s),
kg_pos as (select p, s, o, arg_max(sent_id, n_match * 100000 - sent_id) as sent_id
           from kg_lab where kind = 'pos' group by p, s, o),
kg_posrows as (select l.* from kg_lab l join kg_pos b on l.p = b.p and l.s = b.s and l.o = b.o and l.sent_id = b.sent_id)"""
