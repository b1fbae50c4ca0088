import hashlib

from pyspark.sql import functions as F

from kgenrich.config import RelationSpec
from kgenrich.operators import catalog as D, graph as C, supervise as G

TRIPLES = [
    ("Berlin", "country", "Germany"), ("Paris", "country", "France"), ("Lyon", "country", "France"),
    ("Rhine", "country", "Germany"), ("Bonn", "population", "300 tys."),
    ("Berlin", "type", "City"), ("Berlin", "type", "Place"), ("Paris", "type", "City"),
    ("Paris", "type", "Place"), ("Lyon", "type", "City"), ("Bonn", "type", "City"),
    ("Rhine", "type", "River"), ("Germany", "type", "Country"), ("France", "type", "Country"),
    ("Nice_(France)", "type", "City"),
]


def _kg(spark):
    t = spark.createDataFrame(TRIPLES, "s string, p string, o string")
    return t, t.where("p = 'type'").select(F.col("s").alias("entity"), F.col("o").alias("type"))


def test_select_all_and_types(spark):
    t, ty = _kg(spark)
    assert [tuple(r) for r in C.select_all(t, p="country").collect()] == [
        ("Berlin", "Germany"), ("Lyon", "France"), ("Paris", "France"), ("Rhine", "Germany")]
    assert [r.o for r in C.select_all(t, s="Paris", p="country").collect()] == ["France"]
    st = {(r.s, r.type): r.n for r in C.subject_types(t, ty, "country").collect()}
    assert st[("Berlin", "City")] == 1 and st[("Berlin", "Place")] == 1 and st[("Rhine", "River")] == 1
    assert {r.type: r.n for r in C.count_entities_of_type(ty).collect()}["City"] == 5


def test_minus_and_in_relation(spark):
    t, ty = _kg(spark)
    assert sorted(r.entity for r in C.entities_of_type_not_in_relation(ty, t, "City", "country").collect()) \
        == ["Bonn", "Nice_(France)"]
    assert sorted(r.s for r in C.entities_of_type_in_relation(ty, t, "City", "country").collect()) \
        == ["Berlin", "Lyon", "Paris"]
    assert C.all_subjects(t).count() == 8


def test_predominant_and_candidates(spark):
    t, ty = _kg(spark)
    spec = RelationSpec("country")
    # 4 typed subjects; City is held by 3 (>= 0.75 * 4); Place is wide
    assert [r.type for r in D.predominant_types(t, ty, spec).collect()] == ["City"]
    assert [r.type for r in D.predominant_types(t, ty, spec, subject=False).collect()] == ["Country"]
    assert D.most_specific_types(D.predominant_types(t, ty, spec), ty, threshold=4).count() == 1
    assert D.most_specific_types(D.predominant_types(t, ty, spec), ty, threshold=5).count() == 0
    # default threshold (100) leaves no type -> no candidates
    assert D.candidates(t, ty, spec).count() == 0
    restricted = RelationSpec("country", subject_type="City", name_exclusions=("Nice",))
    assert [r.type for r in D.predominant_types(t, ty, restricted).collect()] == ["City"]


def test_catalog_disambiguation(spark):
    _, ty = _kg(spark)
    cat = {r.name: r.types for r in D.build_catalog(ty, ["City", "Country"]).collect()}
    assert cat["Nice"] == ["City"] and cat["Nice_(France)"] == ["City"] and "Rhine" not in cat


def test_training_pairs_limit(spark):
    t, ty = _kg(spark)
    spec = RelationSpec("country")
    assert G.training_pairs(t, ty, spec, limit=None).count() == 4
    # over the limit: the first pairs by the hash of the pair, whatever the size
    order = sorted((tuple(r) for r in G.training_pairs(t, ty, spec, limit=None).collect()),
                   key=lambda p: hashlib.md5("|".join(p).encode()).hexdigest())
    for n in (1, 3, 4):
        assert sorted(tuple(r) for r in G.training_pairs(t, ty, spec, limit=n).collect()) == sorted(order[:n])
    typed = G.training_pairs(t, ty, RelationSpec("country", subject_type="River"), limit=None)
    assert [tuple(r) for r in typed.collect()] == [("Rhine", "Germany")]


def test_label_and_best_positive(spark):
    W = "array<struct<segment:string,lemma:string,tag:string,parse:string>>"

    def w(*lem):
        return [(x, x, "ign", "") for x in lem]

    sents = spark.createDataFrame([
        ("Paris", 0, w("Paris", "is", "big")),
        ("Paris", 1, w("capital", "of", "France")),
        ("Paris", 2, w("France", "and", "French", "country", "France")),
    ], f"title string, sent_id int, words {W}")
    pairs = spark.createDataFrame([("Paris", "France")], "s string, o string")
    lab = G.label_sentences(pairs, sents, RelationSpec("country"), stop_words=[])
    kinds = {r.sent_id: r.kind for r in lab.collect()}
    assert kinds == {0: "neg", 1: "pos", 2: "pos"}
    best = G.best_positives(lab).first()
    assert best.sent_id == 1       # equal distinct matches -> earliest
    needs = G.label_sentences(pairs, sents, RelationSpec("country", needs_word=True, words=("country",)), [])
    assert {r.sent_id: r.kind for r in needs.collect()} == {0: "neg", 1: "none", 2: "pos"}
    feats = spark.createDataFrame([(w("Paris", "is", "capital", "of", "a"),)], f"words {W}") \
        .select(G.features(F.col("words"), stop_words=["of"]).alias("f")).first().f
    assert feats == ["is", "capital", "a"]
    assert G.vocabulary_threshold(None) == 2 and G.vocabulary_threshold(500) == 5


def test_candidate_limit_and_chunks(spark):
    rows = [(f"E{i:03d}", "type", "Town") for i in range(250)] + \
           [(f"E{i:03d}", "mayor", f"M{i}") for i in range(0, 250, 2)]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    ty = t.where("p = 'type'").select(F.col("s").alias("entity"), F.col("o").alias("type"))
    spec = RelationSpec("mayor", name_exclusions=("E24",))
    cands = D.candidates(t, ty, spec)
    names = sorted(r.entity for r in cands.collect())
    # odd entities lack the relation; names containing "E24" excluded
    assert len(names) == 125 - 5 and all(int(n[1:]) % 2 == 1 for n in names)
    assert [r.entity for r in D.candidates(t, ty, spec, limit=3).collect()] == ["E001", "E003", "E005"]
    chunks = D.chunked(cands, chunk=50)
    assert chunks.rdd.getNumPartitions() == 3 and chunks.count() == 120


def test_training_pairs_one_rule_at_every_size(spark):
    """The draw over the limit is the head of the same hash order."""
    from dataclasses import replace

    from kgenrich.operators import supervise as sup
    from kgenrich.plans import testkg as kg
    t = spark.createDataFrame([(f"s{i}", "nation", f"o{i % 3}", "literal") for i in range(30)], "s string, p string, o string, o_kind string")
    types = spark.createDataFrame([], "entity string, type string")
    spec = replace(kg.relation("nation"), subject_type=None)
    rows = lambda n: {(r.s, r.o) for r in sup.training_pairs(t, types, spec, limit=n).collect()}
    assert len(rows(30)) == 30 and len(rows(29)) == 29 and rows(10) < rows(20) < rows(29)


def test_training_pairs_balanced_over_values(spark):
    """Over the limit every value gets its first pair before any gets a second."""
    rows = [(f"s{i}", "p", "big") for i in range(300)] + [(f"r{i}", "p", f"rare{i}") for i in range(20)] \
        + [("copy", "p", "copied")] * 200
    t = spark.createDataFrame(rows, "s string, p string, o string")
    types = spark.createDataFrame([], "entity string, type string")
    md5 = lambda s, o: hashlib.md5(f"{s}|{o}".encode()).hexdigest()
    pairs = sorted(((s, o) for s, _, o in rows), key=lambda r: md5(*r))
    seen = {}
    order = sorted(((seen.setdefault(o, []).append(s) or len(seen[o]), md5(s, o), s, o) for s, o in pairs))
    for n in (1, 22, 40, 519):
        got = [tuple(r) for r in G.training_pairs(t, types, RelationSpec("p"), limit=n).collect()]
        assert sorted(got) == sorted(r[2:] for r in order[:n])
    assert len({r[3] for r in order[:22]}) == 22
    plain = G.training_pairs(t, types, RelationSpec("p", dedupe_values=False), limit=40).collect()
    assert sorted(tuple(r) for r in plain) == sorted(pairs[:40])


def test_queries_without_a_fit_take_all_pairs(spark, monkeypatch):
    """Labelling ignores the training limit; g1 keeps it."""
    from kgenrich.plans import registry
    draw = G.training_pairs
    monkeypatch.setattr(G, "training_pairs", lambda t, ty, spec, limit=6: draw(t, ty, spec, limit))
    rows = lambda q: registry.QUERIES[q](spark, "/root/testdata/sf0.001").select("s", "o").distinct().count()
    assert rows("g1_training_pairs") <= 12 < rows("k4_paper_labels") < rows("g5_label_sentences")
