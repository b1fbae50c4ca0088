import os
import tempfile

from pyspark.sql import functions as F

from kgenrich.sources import dump, gold, ntriples, tagged

DUMP = """<mediawiki>
<siteinfo><sitename>x</sitename></siteinfo>
<page><title>Nowa Wieś</title><ns>0</ns><id>1</id>
<revision><id>10</id><text xml:space="preserve">first
version</text></revision></page>
<page><title>Kategoria:Wsie</title><ns>14</ns><id>2</id>
<revision><id>11</id><text xml:space="preserve">cat
page</text></revision></page>
<page><title>A/B</title><ns>0</ns><id>3</id>
<revision><id>12</id><text xml:space="preserve">slash</text></revision></page>
<page><title>Nowa Wieś</title><ns>0</ns><id>4</id>
<revision><id>13</id><text xml:space="preserve">second
version</text></revision></page>
</mediawiki>
"""


def _tmp():
    return tempfile.mkdtemp(prefix="kg-test-")


def test_dump_scan_semi_join_and_last_wins(spark):
    d = _tmp()
    with open(os.path.join(d, "dump.xml"), "w") as f:
        f.write(DUMP)
    pages = dump.read_dump(spark, os.path.join(d, "dump.xml"))
    assert pages.count() == 4
    catalog = spark.createDataFrame([("Nowa_Wieś",), ("A/B",)], "name string")
    arts = {r.title: (r.page_id, r.stored_name, r.wikitext) for r in dump.articles_from_dump(pages, catalog).collect()}
    assert arts["Nowa_Wieś"][0] == 4 and arts["Nowa_Wieś"][2].startswith("second")
    assert arts["A/B"][1] == "A_B"
    plain = {r.title for r in dump.plain_pages(pages).collect()}
    assert plain == {"Nowa Wieś"}           # namespace and single-line pages dropped
    recs = dump.plain_corpus(pages).collect()
    assert all(r.value.startswith('<doc id="') and r.value.endswith("</doc>") for r in recs)


def test_doc_url(spark):
    df = spark.createDataFrame([("nowa wieś (gmina)",)], "t string")
    u = df.select(dump.doc_url(F.col("t"), "http://x/").alias("u")).first().u
    assert u == "http://x/Nowa_wie%C5%9B_(gmina)"


def test_ntriples_roundtrip(spark):
    d = _tmp()
    vals = spark.createDataFrame([("Nowa_Wieś", "12"), ("Łódź", "34")], "entity string, value string")
    lines = ntriples.ntriple_lines(vals, "populacja", True)
    ntriples.write_ntriples(lines, os.path.join(d, "nt"))
    back = ntriples.read_ntriples(spark, os.path.join(d, "nt"))
    got = sorted((r.s, r.p, r.o, r.datatype) for r in back.collect())
    assert got == [("Nowa_Wieś", "populacja", "12", ntriples.XSD_INT),
                   ("Łódź", "populacja", "34", ntriples.XSD_INT)]
    text = spark.createDataFrame(
        ['<http://pl.kg.example.org/resource/A> <http://pl.kg.example.org/property/gmina> "Gmina \\"X\\""@pl .',
         '<http://pl.kg.example.org/resource/A> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> '
         '<http://kg.example.org/ontology/Settlement> .', 'garbage line'], "string").toDF("value")
    rows = ntriples.parse_ntriples(text).collect()
    assert len(rows) == 2
    assert rows[0].o == 'Gmina "X"' and rows[0].lang == "pl" and rows[0].o_kind == "literal"
    assert rows[1].p == "22-rdf-syntax-ns#type".split("#")[-1] or rows[1].p == "type"


def test_gold_reader(spark):
    d = _tmp()
    for rel, ents, vals in [("gmina", "A B\nC", "A x\nB y z\nA w"), ("d%C5%82ugo%C5%9B%C4%87", "D", "D 12")]:
        os.makedirs(os.path.join(d, rel))
        open(os.path.join(d, rel, "entities"), "w").write(ents)
        open(os.path.join(d, rel, "values"), "w").write(vals)
    ge, gv = gold.read_gold(spark, d)
    assert sorted((r.p, r.entity) for r in ge.collect()) == [
        ("długość", "D"), ("gmina", "A"), ("gmina", "B"), ("gmina", "C")]
    got = {(r.p, r.entity): r.values for r in gv.collect()}
    assert got[("gmina", "A")] == ["w"]          # repeated entity: last line wins
    assert got[("gmina", "B")] == ["y", "z"] and got[("długość", "D")] == ["12"]


XCES = """<?xml version="1.0" encoding="UTF-8"?>
<chunkList>
<chunk type="p">
 <chunk type="s">
  <tok><orth>Ala</orth><lex disamb="1"><base>Ala</base><ctag>subst:sg:nom:f</ctag></lex><lex><base>al</base><ctag>x</ctag></lex></tok>
  <tok><orth>ma</orth><lex disamb="1"><base>mieć</base><ctag>fin:sg:ter:imperf</ctag></lex></tok>
 </chunk>
 <chunk type="s">
  <tok><orth>Xyz</orth><lex><base>xyz</base><ctag>ign</ctag></lex></tok>
 </chunk>
</chunk>
</chunkList>
"""


def test_xces_conll_roundtrip(spark):
    d = _tmp()
    with open(os.path.join(d, "art.xml"), "w") as f:
        f.write(XCES)
    s = tagged.read_xces(spark, os.path.join(d, "art.xml")).orderBy("sent_id").collect()
    assert [[(w.segment, w.lemma, w.tag) for w in r.words] for r in s] == [
        [("Ala", "Ala", "subst:sg:nom:f"), ("ma", "mieć", "fin:sg:ter:imperf")], [("Xyz", "Xyz", "ign")]]
    sents = tagged.read_xces(spark, os.path.join(d, "art.xml"))
    tagged.write_conll(sents, os.path.join(d, "conll"))
    lab = tagged.read_conll(spark, os.path.join(d, "conll"))
    assert lab.count() == 3
    parsed = spark.createDataFrame([("art", 0, 1, "subj")], "title string, sent_id int, pos int, label string")
    withp = tagged.with_parse(sents, parsed).where("sent_id = 0").first()
    assert [w.parse for w in withp.words] == ["", "subj"]


SPEJD = """<?xml version="1.0" encoding="UTF-8"?>
<chunkList>
<chunk type="p">
 <chunk type="s">
  <group type="NG"><tok><orth>Stary</orth><lex disamb="1"><base>stary</base><ctag>adj:sg:nom:m1</ctag></lex></tok>
   <group type="PrepNG"><tok><orth>w</orth><lex disamb="1"><base>w</base><ctag>prep:loc</ctag></lex></tok></group>
   <tok><orth>dom</orth><lex disamb="1"><base>dom</base><ctag>subst:sg:nom:m3</ctag></lex></tok></group>
  <tok><orth>.</orth><lex disamb="1"><base>.</base><ctag>interp</ctag></lex></tok>
 </chunk>
</chunk>
</chunkList>
"""


def test_shallow_parse_reader(spark):
    d = _tmp()
    with open(os.path.join(d, "art.xml"), "w") as f:
        f.write(SPEJD)
    r = tagged.read_shallow(spark, os.path.join(d, "art.xml")).collect()
    assert len(r) == 1 and r[0].title == "art" and r[0].sent_id == 0
    assert [(w.segment, w.lemma, w.parse) for w in r[0].words] == [
        ("Stary", "stary", "NG"), ("w", "w", "PrepNG"), ("dom", "dom", "NG"), (".", ".", "")]


def test_ntriples_long_literals_and_escapes(spark, tmp_path):
    from kgenrich.sources import ntriples as nt
    values = ["x" * 1_000_000, 'say "hi" \\ there', "two\nlines\tand \\n", '\\"']
    df = spark.createDataFrame([(f"E{i}", v) for i, v in enumerate(values)], "entity string, value string")
    lines = nt.ntriple_lines(df, "p", False)
    got = {r.s: r.o for r in nt.parse_ntriples(lines).collect()}
    assert got == {f"E{i}": v for i, v in enumerate(values)}
    odd = spark.createDataFrame([('<s> <p> "v"@es-419 . # note',), ("no triple",), ("",), ("# comment",)], "value string")
    assert [r.lang for r in nt.parse_ntriples(odd).collect()] == ["es-419"]
    assert [r.value for r in nt.rejected_lines(odd).collect()] == ["no triple"]
