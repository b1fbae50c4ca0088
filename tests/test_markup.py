from pyspark.sql import functions as F

from conftest import one
from kgenrich.functions import markup as M


def test_title_as_link_only_first_pair(spark):
    assert one(spark, M.title_as_link(F.col("v")), "'''A''' x '''B'''") == "[[A]] x '''B'''"


def test_comments_tags(spark):
    assert one(spark, M.drop_comments(F.col("v")), "a<!-- x\n y -->b") == "ab"
    assert one(spark, M.drop_garbage_tags(F.col("v")), "a<ref name=x>cite</ref>b") == "ab"
    assert one(spark, M.drop_wrapper_tags(F.col("v")), "<div class=x>in</div>") == "in"
    assert one(spark, M.drop_single_tags(F.col("v")), "a<br/>b<br>c< br />d") == "abcd"


def test_placeholders_number_and_share(spark):
    t = "<math>x</math> <math>y</math> <math>x</math>"
    # equal blocks keep the first number; the counter still advances
    assert one(spark, M.placeholders(F.col("v")), t) == "formula_1 formula_2 formula_1"


def test_templates_three_levels(spark):
    assert one(spark, M.drop_templates(F.col("v")), "a{{x|{{y|{{z}}}}}}b") == "ab"
    assert one(spark, M.drop_templates(F.col("v")), "a{|\n|t\n|}b") == "ab"


def test_wikilink_parsing(spark):
    def p(s):
        r = one(spark, M.parse_wikilink(F.col("v")), s)
        return r.title, r.text

    assert p("Berlin") == ("Berlin", "Berlin")
    assert p("Berlin|the city") == ("Berlin", "the city")
    assert p("Category:Cities") == ("", "")
    assert p("File:x.jpg|thumb|caption") == ("", "")
    assert p("Wikipedia:About|about") == ("Wikipedia:About".split(":")[-1], "about")
    assert p("de:Berlin") == ("", "")
    assert p("de:Berlin|B") == ("Berlin", "B")
    assert p(":Berlin") == ("Berlin", "Berlin")
    assert p("Page#Section") == ("Section", "Section")


def test_resolve_links_and_leftovers(spark):
    t, links = M.resolve_links(F.col("v"))
    df = spark.createDataFrame([("x [[New_York|NY]] y [[A]] [[File:a|[[B]] c]] [z]] [[w]",)], "v string")
    r = df.select(t.alias("t"), links.alias("l")).first()
    assert "[[" not in r.t and "]]" not in r.t
    assert r.t.startswith("x NY y A")
    assert ("New_York", "NY") in [(x.title, x.text) for x in r.l]


def test_bold_italic_entities(spark):
    assert one(spark, M.bold_italic(F.col("v")), "a '''b''' ''c''") == 'a b &quot;c&quot;'
    assert one(spark, M.named_entities(F.col("v")), "a &amp;lt; b &quot;&quot; &eacute;") == 'a < b " é'
    assert one(spark, M.numeric_entities(F.col("v")), "&#65;&#322;&#128512;") == "Ał"


def test_spacing_and_lines(spark):
    assert one(spark, M.fix_spacing(F.col("v")), "a  ,b\t( c ) .....") == "a,b (c)..."
    text = "\n".join(["one two three four five six", "short line", "* item list is here and long",
                      "== Head ==", "ends with colon one two three four :", "snake_case",
                      "(in brackets only here and more words)", "...", "{table row more words here x}"])
    assert one(spark, M.compact(F.col("v")), text) == "one two three four five six\nsnake_case"
    assert one(spark, M.delete_chars(F.col("v")), "a=b;c*d") == "abcd"
    assert one(spark, M.first_lines(F.col("v"), 2), "1\n2\n3") == "1\n2"


def test_clean_articles_leave_no_markup(spark):
    from kgenrich.operators.text import clean_articles
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet") \
        .selectExpr("cast(page_id as string) as title", "page_id", "html as wikitext")
    out = clean_articles(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        assert "[[" not in r.text and "{{" not in r.text and "<!--" not in r.text


def test_subexpressions_run_once(spark):
    """Inside a lambda every occurrence is evaluated again: a link's parts are
    split once each, and a tag's patterns are in the plan once for all tags."""
    assert str(M.parse_wikilink(F.col("v"))).count("split(") == 4
    for drop, n in ((M.drop_garbage_tags, 1), (M.drop_wrapper_tags, 2), (M.drop_single_tags, 2)):
        assert str(drop(F.col("v"))).count("regexp_replace(") == n


def test_tags_that_other_tags_leave(spark):
    """A tag that only stands there once another one is gone counts as before."""
    assert one(spark, M.drop_wrapper_tags(F.col("v")), "<<b>i>x</<b>I >, <<i>b>y") == "x, <b>y"
    assert one(spark, M.drop_garbage_tags(F.col("v")), "a<re<gallery></gallery>f>gone</ REF>b") == "a<ref>gone</ REF>b"
    assert one(spark, M.drop_garbage_tags(F.col("v")), "a<tab<ref>z</ref>le>gone</ TABLE>b") == "ab"
    assert one(spark, M.drop_single_tags(F.col("v")), "a<BR / ><\\hr>b</ li x>c<brr>") == "abc<brr>"
