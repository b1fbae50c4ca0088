"""Test-data adapter: a knowledge graph and articles derived from the driver tables.

The driver tables hold no triples or wikitext, so they are derived here with
SQL expressions that both Spark (``F.expr``) and DuckDB accept. The oracle
SQL (``plans/oracle.py``) builds the same views from the same expression
strings, so both sides start from identical inputs.

Graph:
  customer --nation--> nation place, --balance--> number text, --segment--> word
  supplier --nation--> nation place;  nation place --region--> region
  part --brand--> brand;  order --customer--> customer;  order --contains--> part
  every entity has ``type`` rows (one specific type plus the wide ``Thing``).
Customers with ``c_custkey % 3 = 0`` are held out of ``nation`` and
``balance``: they are the candidates and the gold set.
Every customer has one wikitext article that states its nation (one of four
phrasings), names a distractor nation, its balance and some markup noise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RelationSpec

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]

# --- entity names (SQL expressions, valid in Spark and DuckDB) -------------
CUST = "replace(c_name, '#', '_')"
SUPP = "replace(s_name, '#', '_')"
PART = "replace(p_name, ' ', '_') || '_(' || cast(p_partkey as string) || ')'"
ORDER = "'Order_' || cast(o_orderkey as string)"
NATION_KEY_NAME = "'Nat' || translate(cast({k} as string), '0123456789', 'aeiouybcdf')"
NATION = NATION_KEY_NAME.format(k="n_nationkey")
REGION = "replace(upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)), ' ', '_')"

BAL_INT = "cast(floor(abs(c_acctbal)) as bigint)"
BAL_CENTS = ("lpad(cast(cast(round((abs(c_acctbal) - floor(abs(c_acctbal))) * 100) "
             "as bigint) as string), 2, '0')")
# KB value of the numeric relation: the number with the kinds of noise the
# value normaliser removes (census note, prefix/suffix words, decimals).
BALANCE_TEXT = (
    f"case c_custkey % 4 when 0 then cast({BAL_INT} as string) "
    f"when 1 then cast({BAL_INT} as string) || ' 2011 Census' "
    f"when 2 then 'ok. ' || cast({BAL_INT} as string) || ' zł' "
    f"else cast({BAL_INT} as string) || ',' || {BAL_CENTS} end"
)
# How the balance is written inside the article: an integer, thousands split
# by a space for odd keys (joined again by the numeral rules).
BALANCE_IN_TEXT = (
    f"case when c_custkey % 2 = 1 and {BAL_INT} >= 1000 then "
    f"cast(cast(floor({BAL_INT} / 1000) as bigint) as string) || ' ' || "
    f"lpad(cast({BAL_INT} % 1000 as string), 3, '0') "
    f"else cast({BAL_INT} as string) end"
)
YEAR = "cast(1990 + c_custkey % 23 as string)"
SEG = "lower(c_mktsegment)"
HOME = NATION_KEY_NAME.format(k="c_nationkey")
DISTRACTOR = NATION_KEY_NAME.format(k="(c_nationkey + 7) % 25")


def _title_sentence(link: bool) -> str:
    """The phrasing that states the customer's nation (wikitext or as cleaned)."""
    def ln(x, piped=False):
        if not link:
            return f"' || {x} || '"
        return f"[[' || {x} || '|' || {x} || ']]" if piped else f"[[' || {x} || ']]"
    return (
        "case c_custkey % 4 "
        f"when 0 then ' is a customer registered in {ln(HOME)} and served by the ' || {SEG} || ' division since ' || {YEAR} || '.' "
        f"when 1 then ' is a ' || {SEG} || ' customer whose home nation is {ln(HOME, True)} and whose ledger opened in ' || {YEAR} || '.' "
        f"when 2 then ' is an account located in the nation of {ln(HOME)} with many regular orders.' "
        f"else ' is a trading account from {ln(HOME)} known for its ' || {SEG} || ' orders and fast payments.' end"
    )


TITLE_SENTENCE = _title_sentence(True)
# What the cleaner must leave of an article: four sentences (oracle only).
EXPECTED_SENTENCES = [
    f"replace({CUST}, '_', ' ') || {_title_sentence(False)}",
    f"'The account was opened in ' || {YEAR} || ' by a local office with a staff of \"several\" people.'",
    f"'Its largest supplier ships goods from ' || {DISTRACTOR} || ' to the warehouse every week.'",
    f"'The account balance reached ' || cast({BAL_INT} as string) || ' units at the end of the last year.'",
]
# The cleaned text itself (numerals are joined later, per token).
EXPECTED_CLEAN_LINES = EXPECTED_SENTENCES[:3] + [
    f"'The account balance reached ' || {BALANCE_IN_TEXT} || ' units at the end of the last year.'"]
NL = "chr(10)"
ARTICLE = " || ".join([
    "'{{Infobox customer'", NL, f"'| name = ' || {CUST}", NL,
    f"'| segment = ' || {SEG}", NL, "'}}'", NL,
    f"'''''''' || {CUST} || '''''''' || {TITLE_SENTENCE}", NL,
    "'<!-- generated entry -->'", NL,
    "'== History =='", NL,
    f"'The account was opened in ' || {YEAR} || ' by a local office<ref>Ledger ' || {YEAR} || '</ref> with a staff of &quot;several&quot; people.'", NL,
    f"'Its largest supplier ships goods from [[' || {DISTRACTOR} || ']] to the warehouse every week.'", NL,
    f"'The account balance reached ' || {BALANCE_IN_TEXT} || ' units at the end of the last year.'", NL,
    "'* Markets'", NL,
    "'Short line.'", NL,
    "'[[Category:Customers]]'",
])


def _customer(k: str) -> str:
    return f"'Customer_' || lpad(cast({k} as string), 9, '0')"


# Redirect pages of customers (K2): (title, page id, target, filter). By the last
# digit of the key: 1 to 5 are a chain that ends at 6, 7 and 8 point at each
# other, 9 leads into that cycle; 3 has a second, later page that ends the
# chain early, 4 a second, earlier one that does not count.
REDIRECT_PAGES = [
    (CUST, "c_custkey", _customer("c_custkey + 1"), "c_custkey % 10 in (1, 3, 4, 5, 7)"),
    ("replace(c_name, '#', ' ')", "c_custkey", f"replace({_customer('c_custkey + 1')}, '_', ' ')", "c_custkey % 10 = 2"),
    (CUST, "c_custkey", _customer("c_custkey - 1"), "c_custkey % 10 in (8, 9)"),
    (CUST, "c_custkey + 100000000", _customer("c_custkey + 3"), "c_custkey % 10 = 3"),
    (CUST, "c_custkey - 100000000", "'Nowhere'", "c_custkey % 10 = 4"),
]
REDIRECT_TEXT = "'#REDIRECT [[' || {target} || ']]'"

# Pages of a dump (A1, A2): (title, page id, text, place in the dump, filter). Beside
# the articles there are older and newer versions, a title that differs by "/"
# only, pages of another namespace and pages of one line.
DUMP_PAGES = [
    (CUST, "c_custkey", ARTICLE, "2 * c_custkey + 1", "true"),
    (CUST, "c_custkey", f"'old text of ' || {CUST}", "2 * c_custkey", "c_custkey % 5 = 0"),
    (CUST, "c_custkey + 1000000", f"'new text of ' || {CUST}", "100000000 + c_custkey", "c_custkey % 7 = 0"),
    (f"replace({CUST}, '_', '/')", "c_custkey + 2000000", f"'other title of ' || {CUST}", "200000000 + c_custkey", "c_custkey % 11 = 0"),
    ("'Template:' || c_name", "c_custkey + 3000000", ARTICLE, "300000000 + c_custkey", "c_custkey % 9 = 0"),
]

# Hypernyms (F15, F16): part -> brand -> type word, and a ladder over the nation
# keys in which both nodes of a rung lead to both of the next: 2^24 paths.
_RUNG = "'rung' || cast(n_nationkey + {up} as string) || '{side}'"
HYPERNYMS = [
    ("part", "'part' || cast(p_partkey as string)", "p_brand"),
    ("part", "p_brand", "'type ' || lower(p_type)"),
    ("part", "'type ' || lower(p_type)", "'thing'"),
    ("part", "'part' || cast(p_partkey as string)", "'type ' || lower(p_type)"),
    *[("nation", _RUNG.format(up=0, side=a), _RUNG.format(up=1, side=b)) for a in "ab" for b in "ab"],
]
# Senses of the words that name market segments: (lemma, part of speech, rank, synset).
SENSES = ("customer", SEG, "case when c_custkey % 2 = 0 then 'n' else 'v' end", "c_custkey % 5",
          f"{SEG} || '.' || cast(c_custkey % 5 as string)")


def redirect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(title, page_id, wikitext)`` of redirect pages and of the articles."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = [c.where(F.expr(w)).select(F.expr(t).alias("title"), F.expr(i).alias("page_id"),
                                       F.expr(REDIRECT_TEXT.format(target=to)).alias("wikitext"))
             for t, i, to, w in REDIRECT_PAGES]
    return reduce(DataFrame.unionAll, parts).unionAll(articles(spark, sf_dir).where("page_id % 10 in (0, 6)"))


def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(title, page_id, wikitext, place)``."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return reduce(DataFrame.unionAll, [
        c.where(F.expr(w)).select(F.expr(t).alias("title"), F.expr(i).cast("long").alias("page_id"),
                                  F.expr(x).alias("wikitext"), F.expr(o).cast("long").alias("place"))
        for t, i, x, o, w in DUMP_PAGES])


def hypernyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(synset, parent)``."""
    t = load_tables(spark, sf_dir, ["part", "nation"])
    return reduce(DataFrame.unionAll, [t[n].select(F.expr(s).alias("synset"), F.expr(o).alias("parent"))
                                       for n, s, o in HYPERNYMS])


def senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(lemma, pos, rank, synset)``."""
    table, *cols = SENSES
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(
        *[F.expr(c).alias(n) for c, n in zip(cols, ("lemma", "pos", "rank", "synset"))]).distinct()


# Markup that the articles do not hold (E7, E10-E12, E14, E15), one text a customer:
# (step, text with the markup, text without it, from the same columns).
_K, _Q = "cast(c_custkey as string)", "chr(39)"
MARKUP_NOISE = [
    ("e7_placeholders",
     f"'x <math>a' || {_K} || '</math> and <code>b' || {_K} || '</code> then <math>a' || {_K} || '</math>, <math>c</math> ' || {SEG}",
     f"'x formula_1 and codice_1 then formula_1, formula_3 ' || {SEG}"),
    ("e10_malformed_links",
     f"'From [Town|the town]] of ' || {SEG} || ' to [[' || {HOME} || '] and [[ on ]] ' || {_K}",
     f"'From the town of ' || {SEG} || ' to ' || {HOME} || ' and on ' || {_K}"),
    ("e11_web_links",
     f"'See [http://' || {SEG} || '.org/' || {_K} || ' a label]the page[] of [HTTPS://x y] ' || {HOME}",
     f"'See the page of  ' || {HOME}"),
    ("e12_bold_italic",
     f"'l' || {_Q} || {_Q} || {_Q} || {_Q} || {HOME} || {_Q} || {_Q} || {_Q} || ' or ' || {_Q} || {_Q} || {_Q} || 'bold' || {_Q} || {_Q} || {_Q}"
     f" || ' and ' || {_Q} || {_Q} || {SEG} || {_Q} || {_Q}",
     f"'l' || {_Q} || {HOME} || ' or bold and &quot;' || {SEG} || '&quot;'"),
    ("e14_code_points",
     f"'a&#' || cast(65 + c_custkey % 26 as string) || ';b&#66000;c&#281;' || {_K}",
     f"'a' || chr(cast(65 + c_custkey % 26 as int)) || 'bcę' || {_K}"),
    ("e15_loose_spacing",
     f"'one' || chr(9) || 'two  ' || {SEG} || ' ..... four , five ( ' || {_K} || ' ) « ' || {HOME} || ' » eight ; nine :'",
     f"'one two ' || {SEG} || '... four, five (' || {_K} || ') «' || {HOME} || '» eight; nine:'"),
]


def load_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    names = names or TABLES
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _t(df: DataFrame, s: str, p: str, o: str, where: str | None = None) -> DataFrame:
    if where:
        df = df.where(F.expr(where))
    return df.select(F.expr(s).alias("s"), F.lit(p).alias("p"), F.expr(o).alias("o"))


# (table, subject expr, predicate, object expr, filter) -- shared with the oracle
TRIPLE_SOURCES = [
    ("customer", CUST, "type", "'Customer'", None),
    ("customer", CUST, "type", "'Thing'", None),
    ("supplier", SUPP, "type", "'Supplier'", None),
    ("supplier", SUPP, "type", "'Thing'", None),
    ("part", PART, "type", "'Part'", None),
    ("part", PART, "type", "'Thing'", None),
    ("nation", NATION, "type", "'Nation'", None),
    ("nation", NATION, "type", "'Place'", None),
    ("nation", NATION, "type", "'Thing'", None),
    ("region", REGION, "type", "'Region'", None),
    ("region", REGION, "type", "'Place'", None),
    ("region", REGION, "type", "'Thing'", None),
    ("orders", ORDER, "type", "'Order'", None),
    ("orders", ORDER, "type", "'Thing'", None),
    ("customer", CUST, "nation", HOME, "c_custkey % 3 <> 0"),
    ("customer", CUST, "balance", BALANCE_TEXT, "c_custkey % 3 <> 0"),
    ("customer", CUST, "segment", SEG, None),
    ("supplier", SUPP, "nation", NATION_KEY_NAME.format(k="s_nationkey"), None),
    ("nation", NATION, "region", REGION.replace("r_name", "nr_name"), None),
    ("part", PART, "brand", "p_brand", None),
    ("orders", ORDER, "customer", "'Customer_' || lpad(cast(o_custkey as string), 9, '0')", None),
    ("lineitem_part", "'Order_' || cast(l_orderkey as string)", "contains", PART, None),
]


def _source(t: dict[str, DataFrame], name: str) -> DataFrame:
    if name == "nation":
        r = t["region"].select("r_regionkey", F.col("r_name").alias("nr_name"))
        return t["nation"].join(r, t["nation"].n_regionkey == r.r_regionkey, "left")
    if name == "lineitem_part":
        return t["lineitem"].select("l_orderkey", "l_partkey").join(
            t["part"].select("p_partkey", "p_name"),
            F.col("l_partkey") == F.col("p_partkey"))
    return t[name]


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``triples(s, p, o)`` -- the whole derived graph, type rows included."""
    t = load_tables(spark, sf_dir, ["region", "nation", "customer", "supplier",
                                    "part", "orders", "lineitem"])
    parts = [_t(_source(t, src), s, p, o, w) for src, s, p, o, w in TRIPLE_SOURCES]
    return reduce(DataFrame.unionAll, parts)


def types(triples_df: DataFrame) -> DataFrame:
    """``types(entity, type)`` view of the type rows (M2)."""
    return triples_df.where(F.col("p") == "type").select(
        F.col("s").alias("entity"), F.col("o").alias("type"))


def facts(triples_df: DataFrame) -> DataFrame:
    return triples_df.where(F.col("p") != "type")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``articles(title, page_id, wikitext)`` -- one per customer (M5)."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.expr(CUST).alias("title"), F.col("c_custkey").alias("page_id"),
                    F.expr(ARTICLE).alias("wikitext"))


def gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Held-out gold: ``gold_entities(p, entity)``, ``gold_values(p, entity, values)``."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0")
    ents = c.select(F.lit("nation").alias("p"), F.expr(CUST).alias("entity")).unionAll(
        c.select(F.lit("balance").alias("p"), F.expr(CUST).alias("entity")))
    vals = c.select(F.lit("nation").alias("p"), F.expr(CUST).alias("entity"),
                    F.array(F.expr(HOME)).alias("values")).unionAll(
        c.select(F.lit("balance").alias("p"), F.expr(CUST).alias("entity"),
                 F.array(F.expr(f"cast({BAL_INT} as string)")).alias("values")))
    return ents, vals


RELATIONS = [
    RelationSpec("nation", words=("nation",)),
    RelationSpec("balance", is_numeric=True, subject_type="Customer",
                 words=("balance",)),
    RelationSpec("region", needs_word=True, words=("region",)),
    RelationSpec("segment", allow_unknown_value=True),
]
CATALOG_TYPES = ["Place", "Nation", "Region", "Part"]


def relation(p: str) -> RelationSpec:
    return next(r for r in RELATIONS if r.p == p)
