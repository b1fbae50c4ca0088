"""Sources draw and permute by their whole names."""

from kgenrich.llm import mixing


def test_names_with_a_common_start_get_seeds_of_their_own():
    names = ["source_alpha", "source_beta", "web-crawl-1", "web-crawl-2", "wikipedia-en", "wikipedia-de", None, "None", ""]
    seeds = {mixing.source_seed(n, 17) for n in names}
    assert len(seeds) == len(names)
    assert [mixing.source_seed(n, 17) for n in names] == [mixing.source_seed(n, 17) for n in names]


def test_equal_sources_with_other_names_are_mixed_differently(spark):
    rows = [(1000 * s + i, " ".join(f"w{i}_{j}" for j in range(40)), name)
            for s, name in enumerate(["web-crawl-1", "web-crawl-2"]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, pieces = mixing.plan(docs, block=32)
    key = {r.row_key: r.doc_id for r in mixing.plan(docs, block=32)[0].collect()}
    takes = {}
    for r in pieces.collect():
        takes.setdefault(key[r.row_key] // 1000, set()).add((key[r.row_key] % 1000, r.shard, r.turn, r.at))
    same = len(takes[0] & takes[1]) / len(takes[0])
    assert same < 0.5
    again = {(key[r.row_key], r.shard, r.turn, r.at) for r in mixing.plan(docs, block=32)[1].collect()}
    assert again == {(1000 * s + d, *rest) for s, t in takes.items() for d, *rest in t}
