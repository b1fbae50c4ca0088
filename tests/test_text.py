import time

from pyspark.sql import functions as F

from kgenrich.operators import text as T

WORDS = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"


def _words(spark, lemmas, segs=None):
    segs = segs or lemmas
    ws = [(s, l, "ign", "") for s, l in zip(segs, lemmas)]
    return spark.createDataFrame([(ws,)], f"w {WORDS}")


def _run(spark, fn, lemmas, segs=None):
    df = _words(spark, lemmas, segs)
    return [w.lemma for w in df.select(fn(F.col("w")).alias("r")).first().r]


def test_join_decimal_numerals(spark):
    assert _run(spark, T.join_decimal_numerals, ["3", ",", "5", "km"]) == ["3,5", "km"]
    assert _run(spark, T.join_decimal_numerals, ["1", ".", "000"]) == ["1000"]
    # one pass, not chaining: the merged token is not re-examined
    assert _run(spark, T.join_decimal_numerals, ["1", ",", "2", ",", "3"]) == ["1,2", ",", "3"]
    assert _run(spark, T.join_decimal_numerals, ["a", ",", "5"]) == ["a", ",", "5"]


def test_join_adjacent_numerals_chains(spark):
    assert _run(spark, T.join_adjacent_numerals, ["100", "000", "000", "x"]) == ["100000000", "x"]
    assert _run(spark, T.join_adjacent_numerals, ["x", "1", "y", "2"]) == ["x", "1", "y", "2"]


def test_multipliers(spark):
    assert _run(spark, T.apply_multipliers, ["12,1", "tys", ".", "osób"]) == ["12100", "osób"]
    assert _run(spark, T.apply_multipliers, ["0,9", "mln", "."]) == ["900000", "."]
    assert _run(spark, T.apply_multipliers, ["2", "tysiąc"]) == ["2000"]
    assert _run(spark, T.join_numerals, ["1", "200", ",", "5", "tys", "."]) == ["1200500"]


def test_correct_lemmas_capital_rule(spark):
    df = _words(spark, ["ala", "warszawa", "Województwo"], ["Ala", "Warszawa", "Województwo"])
    links = F.create_map(F.lit("Ala"), F.lit("Alicja"))
    r = df.select(T.correct_lemmas(F.col("w"), links).alias("r")).first().r
    # link lemma for the first word; the capital rule (after position 0) puts
    # the segment back, also over the lower-case override
    assert [w.lemma for w in r] == ["Alicja", "Warszawa", "Województwo"]
    df = _words(spark, ["Województwo", "x"], ["Województwo", "x"])
    r = df.select(T.correct_lemmas(F.col("w")).alias("r")).first().r
    assert [w.lemma for w in r] == ["województwo", "x"]


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([("d", "Ma 3.5 km. Drugie zdanie!\nTrzecie, Łódź-x")], "title string, text string")
    s = T.sentences(df).orderBy("sent_id").collect()
    assert [r.tokens for r in s] == [["Ma", "3", ".", "5", "km", "."], ["Drugie", "zdanie", "!"],
                                     ["Trzecie", ",", "Łódź", "-", "x"]]


def test_link_dictionary_prefix_rule(spark):
    clean = spark.createDataFrame(
        [("a", [("Nowy Jork", "Nowym Jorku"), ("Other", "x")])],
        "title string, links array<struct<title:string,text:string>>")
    catalog = spark.createDataFrame([("Nowy_Jork", ["City"])], "name string, types array<string>")
    d = T.link_dictionary(clean, catalog).first().links_map
    assert d == {"Nowym": "Nowy", "Jorku": "Jork"}


def test_prepare_articles_end_to_end(spark):
    raw = spark.createDataFrame(
        [("Ala", 1, "'''Ala''' is a town in [[Big_Land|Big Land]] with 1 200 people.\n"
                    "Second line is long enough to keep here.")],
        "title string, page_id long, wikitext string")
    catalog = spark.createDataFrame([("Big_Land", ["Place"])], "name string, types array<string>")
    s = T.prepare_articles(raw, catalog).orderBy("sent_id").collect()
    lem = [w.lemma for w in s[0].words]
    assert "1200" in lem and "Big" in lem and "Land" in lem


def test_long_dotted_line_and_unicode_spaces(spark):
    """A megabyte without blanks, and non-breaking spaces between digits."""
    from pyspark.sql import functions as F

    from kgenrich.operators import text as tx
    df = spark.createDataFrame([("a." * 500_000,), ("To ma 100\u00a0000 osób. Koniec!! 3.5 km",)], "t string")
    got = [r.s for r in df.select(tx.split_sentences(F.col("t")).alias("s")).collect()]
    assert [len(x) for x in got] == [1, 3]
    toks = spark.createDataFrame([(got[1][0],)], "t string").select(tx.tokenize(F.col("t")).alias("w")).first().w
    assert toks == ["To", "ma", "100", "000", "osób", "."]
    words = spark.range(1).select(F.array().cast(f"array<{tx.WORD}>").alias("w"))
    r = words.select(tx.join_decimal_numerals(F.col("w")).alias("a"), tx.apply_multipliers(F.col("w")).alias("b")).first()
    assert r.a == [] and r.b == []


def test_cleaning_is_dealt_out_whatever_the_input_files(spark):
    n = 2 * T.ARTICLES_PER_PARTITION + 1
    raw = spark.range(n, numPartitions=1).selectExpr("'t' || id as title", "id as page_id", "'x [[Y|y]] z' as wikitext")
    clean = T.clean_articles(raw)
    held = [r[0] for r in clean.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert sum(held) == n and len(held) == 3 and max(held) < n / 2


def test_numerals_far_apart_and_single_ones_stay(spark):
    for fn in (T.join_decimal_numerals, T.join_adjacent_numerals, T.apply_multipliers):
        assert _run(spark, fn, ["rok", "1990", "i", "2001"]) == ["rok", "1990", "i", "2001"]
        assert _run(spark, fn, []) == []


def test_a_long_sentence_without_joined_numerals_is_not_rebuilt(spark):
    """Rebuilding appends word by word, whose time grows with the square of the words."""
    n = 100000
    lemma = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i % 10 == 0, i.cast("string")).otherwise("a"))
    df = spark.range(1).select(F.transform(lemma, lambda x: F.struct(
        x.alias("segment"), x.alias("lemma"), F.lit("ign").alias("tag"), F.lit("").alias("parse"))).alias("w")).localCheckpoint()
    begun = time.monotonic()
    for fn in (T.join_decimal_numerals, T.join_adjacent_numerals):
        assert df.select((fn(F.col("w")) == F.col("w")).alias("same")).first().same
    assert time.monotonic() - begun < 8


def test_numerals_meet_over_separators_only(spark):
    dec, adj = T.join_decimal_numerals, T.join_adjacent_numerals
    assert _run(spark, dec, ["a1", ",", "5", "3", "", "5"]) == ["a1", ",", "5", "3,5"]
    assert _run(spark, dec, ["3", ".,", "5"]) == ["3,5"]
    assert _run(spark, dec, ["3", ";", "5"]) == ["3", ";", "5"]
    assert _run(spark, dec, ["3", None, "5", ",", "6"]) == ["3", None, "5,6"]
    assert _run(spark, dec, [".5", ".", "+6e2"]) == [".5+6e2"]
    assert _run(spark, adj, ["1", None, "2"]) == ["1", None, "2"]
    assert _run(spark, adj, ["x2", "3", "4,5", "y"]) == ["x2", "34,5", "y"]
    assert _run(spark, adj, ["1", "", "2"]) == ["1", "", "2"]


def _titled(spark):
    raw = [("A", "The odd town of [[Big_Land|Big Land]] is the odd one of all. It was odd."),
           ("A", "Odd ODD of the three is a town that we know well here. Is it so."),
           ("A", "Odd ODD of the three is a town that we know well here. Is it so."),
           (None, "The town of [[Big_Land|Big Land]] is it, as it was an Odd one."), ("B", None)]
    return spark.createDataFrame([(t, i, x) for i, (t, x) in enumerate(raw)], "title string, page_id long, wikitext string"), \
        spark.createDataFrame([("Big_Land", ["Place"])], "name string, types array<string>")


def test_preparation_deals_out_articles_not_tokens(spark):
    raw, catalog = _titled(spark)
    plan = T.prepare_articles(raw, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(title" in plan
    assert "hashpartitioning(form" not in plan and "sent_id" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)


def test_tags_by_case_are_those_of_the_corpus_lexicon(spark):
    """Repeated and null titles, forms whose lower-case form occurs or not."""
    raw, catalog = _titled(spark)
    clean = T.clean_articles(raw)
    sents = T.sentences(clean)
    tagged = T.tag_sentences(sents, T.lexicon_from_corpus(sents), unique_forms=True).join(
        T.link_dictionary(clean, catalog), "title", "left")
    want = tagged.select("title", "sent_id", T.correct_lemmas(F.col("words"), F.col("links_map")).alias("words"))
    for stage in (T.join_decimal_numerals, T.join_adjacent_numerals, T.apply_multipliers):
        want = want.select("title", "sent_id", stage(F.col("words")).alias("words"))
    got = T.prepare_articles(raw, catalog)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 3
