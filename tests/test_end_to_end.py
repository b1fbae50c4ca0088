from kgenrich.operators import catalog as cat
from kgenrich.plans import jobs, testkg

SF = "/root/testdata/sf0.001"


def test_planted_relations_end_to_end(spark):
    c = jobs.demo_corpus(spark, SF)
    for p in ["nation", "balance"]:
        spec = testkg.relation(p)
        m = jobs.train_models(c, spec, crf_iter=40)
        scores, table, values = jobs.evaluate_relation(c, spec, m)
        s = scores.first()
        assert s.f_measure >= 0.9, (p, s)
        # every error row is explained by the error table
        assert table.where("error <> ''").count() == s.fp + s.fn - table.where("error = 'FP/FN'").count()
    # enrichment writes one N-Triples line per candidate with a value
    spec = testkg.relation("balance")
    lines = jobs.enrich(c, spec, m).collect()
    n_cand = cat.candidates(c.triples, c.types, spec).count()
    assert 0 < len(lines) <= n_cand
    assert all(l.value.endswith('"^^<http://www.w3.org/2001/XMLSchema#int> .') for l in lines)
