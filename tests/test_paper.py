import time

from pyspark.sql import functions as F

from kgenrich.config import RelationSpec
from kgenrich.operators import paper as K

W = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"


def _w(*segs):
    return [(s, s.lower() if i == 0 else s, "ign", "") for i, s in enumerate(segs)]


def test_join_names_longest_first(spark):
    s = spark.createDataFrame([("a", 0, _w("W", "Nowa", "Wieś", "Duża", "i", "Nowa", "Wieś"))],
                              f"title string, sent_id int, words {W}")
    cat = spark.createDataFrame([("Nowa_Wieś",), ("Nowa_Wieś_Duża",)], "name string")
    r = K.join_names(s, cat).first().words
    assert [w.segment for w in r] == ["W", "Nowa_Wieś_Duża", "i", "Nowa_Wieś"]
    none = spark.createDataFrame([("b", 0, _w("x", "y"))], f"title string, sent_id int, words {W}")
    assert [w.segment for w in K.join_names(none, cat).first().words] == ["x", "y"]


def test_name_hits_of_a_long_sentence_take_time_in_proportion(spark):
    n = 20000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(
        F.concat(F.lit("w"), i.cast("string")).alias("segment"), F.lit("x").alias("lemma"), F.lit("ign").alias("tag"), F.lit("").alias("parse")))
    s = spark.range(1).select(F.col("id").cast("string").alias("title"), F.lit(0).alias("sent_id"), words.alias("words")).localCheckpoint()
    cat = spark.createDataFrame([("w7_w8",), ("w7_w8_w9",), (f"w{n - 1}_w{n}",), (f"w{n - 1}_w{n}_w{n + 1}",), ("w1_w3",)], "name string")
    begun = time.monotonic()
    got = sorted((r.i, r.k) for r in K.name_hits(s, cat).collect())
    assert got == [(6, 3), (n - 2, 2)]
    assert time.monotonic() - begun < 12        # the segments taken again at every position: several times as long


def test_name_hits_skip_null_segments(spark):
    s = spark.createDataFrame([("a", 0, [("x", "", "", ""), (None, "", "", ""), ("y", "", "", ""), ("z", "", "", "")]), ("b", 0, None), ("c", 0, [])],
                              f"title string, sent_id int, words {W}")
    cat = spark.createDataFrame([("x_y",), ("y_z",), (None,)], "name string")
    assert [(r.title, r.i, r.k) for r in K.name_hits(s, cat).collect()] == [("a", 2, 2)]


def test_redirects_and_canonical(spark):
    pages = spark.createDataFrame(
        [("USA", 7, "#REDIRECT [[Stany Zjednoczone]]"), ("X", 8, "text"), ("U S", 3, "#redirect [[Early]]"),
         ("U S", 9, "#patrz: [[USA|x]]"), ("U_S", 5, "#REDIRECT [[Middle]]"), (None, 1, "#REDIRECT [[Y]]"), ("Z", 2, None)],
        "title string, page_id long, wikitext string")
    r = K.redirects(pages)
    assert sorted(tuple(x) for x in r.collect()) == [("USA", "Stany_Zjednoczone"), ("U_S", "USA")]
    vals = spark.createDataFrame([("e", "U_S"), ("f", "Polska")], "entity string, value string")
    got = {x.entity: x.value for x in K.canonical_names(vals, "value", K.resolve_redirects(r)).collect()}
    assert got == {"e": "Stany_Zjednoczone", "f": "Polska"}


def follow(links, name):
    path = []
    while name in links and name not in path:
        path.append(name)
        name = links[name]
    return min(path[path.index(name):]) if name in path else name


def test_redirect_chains_and_cycles_of_any_length(spark):
    links = {f"c{i:03}": f"c{i + 1:03}" for i in range(300)}                     # one long chain
    for n in (1, 2, 3, 5, 8, 12):                                                # cycles, a tail of n + 1 into each
        links |= {f"y{n}_{i:02}": f"y{n}_{(i + 1) % n:02}" for i in range(n)}
        links |= {f"a{n}_{i:02}": f"a{n}_{i + 1:02}" for i in range(n)} | {f"a{n}_{n:02}": f"y{n}_{n // 2:02}"}
    links |= {f"many{i}": "c000" for i in range(200)}                            # a popular target
    for part in (links, {k: v for k, v in links.items() if k[0] in "cm"}, {"a": "a"}, {"a": "b"}, {}):
        df = spark.createDataFrame(list(part.items()), "name string, canonical string")
        got = {r.name: r.canonical for r in K.resolve_redirects(df).collect()}
        assert got == {n: follow(part, n) for n in part}


def test_join_names_equal_a_walk_over_all_names(spark):
    import random
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6)]
    names = {"_".join(rng.choices(vocab, k=rng.choice([1, 2, 2, 3, 4]))) for _ in range(25)}
    sents = [(f"t{i}", j, _w(*rng.choices(vocab, k=rng.choice([0, 1, 2, 9, 15])))) for i in range(20) for j in range(3)]

    def walk(segs):
        out, i = [], 0
        while i < len(segs):
            k = max([k for k in range(2, 5) if i + k <= len(segs) and "_".join(segs[i:i + k]) in names], default=1)
            out.append("_".join(segs[i:i + k]))
            i += k
        return out

    df = spark.createDataFrame(sents, f"title string, sent_id int, words {W}")
    cat = spark.createDataFrame([(n,) for n in names], "name string")
    for limit in (K.SMALL_INDEX, 0):                    # starts broadcast, starts shuffled
        K.SMALL_INDEX, kept = limit, K.SMALL_INDEX
        got = {(r.title, r.sent_id): [w.segment for w in r.words] for r in K.join_names(df, cat).collect()}
        K.SMALL_INDEX = kept
        want = {(t, i): walk([w[0] for w in ws]) for t, i, ws in sents}
        assert got == want and any("_" in x for v in want.values() for x in v)


def test_extra_features(spark):
    df = spark.createDataFrame([(_w("Nowa_Wieś", "1410", "x"), [["City"], [], []])],
                               f"words {W}, types array<array<string>>")
    f = df.select(K.extra_features(F.col("words"), F.col("types")).alias("f")).first().f
    assert f[0] == ["position=0", "allcaps=1", "year=0", "type_City=1"]
    assert f[1] == ["position=1", "allcaps=0", "year=1"]


def test_paper_label_rule(spark):
    sents = spark.createDataFrame([
        ("P", 0, _w("Rzeka", "Wisła")), ("P", 1, _w("uchodzi", "do", "Wisła")), ("Q", 0, _w("x", "Wisła"))],
        f"title string, sent_id int, words {W}")
    pairs = spark.createDataFrame([("P", "Wisła"), ("Q", "Wisła")], "s string, o string")
    lab = K.label_sentences_paper(pairs, sents, RelationSpec("uchodziDo", words=("uchodzi",)), [])
    got = {(r.s, r.sent_id): r.kind for r in lab.collect()}
    # P has two matches: only the one with the relation word; Q's only match counts
    assert got == {("P", 0): "none", ("P", 1): "pos", ("Q", 0): "pos"}


def test_split_scores(spark):
    kept = spark.createDataFrame([("a", 0, _w("x", "Alfa")), ("b", 0, _w("y", "z"))],
                                 f"title string, sent_id int, words {W}")
    gold = spark.createDataFrame([("a", ["Alfa"]), ("b", ["Beta"]), ("c", ["Gamma"])], "entity string, values array<string>")
    c = K.classifier_scores(kept, gold, RelationSpec("r"), "r", stop_words=[]).first()
    assert (c.tp, c.fp, c.fn) == (1, 1, 2)
    vals = spark.createDataFrame([("a", "Alfa"), ("c", "Gamma")], "entity string, value string")
    e = K.extractor_scores(vals, gold, kept, "r").first()
    assert (e.tp, e.fp, e.fn) == (1, 0, 1)


def test_redirect_rounds_keep_a_size_spark_can_plan_with(spark):
    """The estimate of a chain of joins is a number with twice the digits every round."""
    n = 300
    df = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % n}") for i in range(n)], "name string, canonical string")
    table = K.resolve_redirects(df)
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 200
    assert {r.canonical for r in table.collect()} == {"n0"}
