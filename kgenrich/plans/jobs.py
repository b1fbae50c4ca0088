"""End-to-end jobs as one DataFrame lineage per relation.

``Corpus`` bundles the inputs (triples, types, catalog, prepared sentences,
gold). Sentences are prepared once for all articles and persisted; after
training, candidates' sentences are scored, tagged, decoded and reduced to
one value per entity. Models are the only things collected (vocabulary,
SVM coefficients, CRF weights).
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CRF_ITERATIONS, LEARNING_CURVE_CAPS, LEARNING_CURVE_RUNS, RelationSpec
from ..operators import catalog as cat
from ..operators import classify, crf, evaluate as ev, extract, supervise as sup, text
from ..session import checkpoint_dir, stage_table
from ..sources import ntriples
from . import cache, testkg


@dataclass
class Corpus:
    triples: DataFrame
    types: DataFrame
    catalog: DataFrame
    sentences: DataFrame
    gold_entities: DataFrame | None = None
    gold_values: DataFrame | None = None
    stop_words: list | None = None


@dataclass
class Models:
    classifier: classify.SentenceClassifier
    extractor: crf.CRFModel
    positives: DataFrame
    n_positives: int
    extras: dict = field(default_factory=dict)


def prepare_corpus(raw_articles: DataFrame, catalog: DataFrame, lexicon: DataFrame | None = None,
                   persist: bool = True) -> DataFrame:
    """P3 (text side): clean every article once, tag, keep the first sentences.

    The lexicon is learnt from the whole corpus when none is given, so train
    and candidate sentences share lemmas. The result is a stage table under
    ``spark.checkpoint.dir``: later jobs start from it, reading only the parts of
    the words that they need, instead of re-running the cleaner, and lost
    executors recompute nothing upstream."""
    s = text.prepare_articles(raw_articles, catalog, lexicon=lexicon)
    return stage_table(s, "sentences") if persist else s


def cached_corpus(spark: SparkSession, articles_path: str, catalog: DataFrame, root: str | None = None,
                  **params) -> DataFrame:
    """The prepared sentences of the articles (parquet) at ``articles_path``: made
    once, read while neither the articles, the catalog nor ``params`` change."""
    digest = catalog.agg(F.count("*"), F.sum(F.xxhash64("name").cast("decimal(38,0)"))).first()
    return cache.cached(spark, "sentences", lambda: text.prepare_articles(spark.read.parquet(articles_path), catalog, **params),
                        [articles_path], {"catalog": [str(x) for x in digest], **params}, root)


def demo_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The test-data adapter's graph and articles as a Corpus."""
    t = testkg.triples(spark, sf_dir)
    ty = testkg.types(t)
    catalog = cat.build_catalog(ty, testkg.CATALOG_TYPES)
    sents = prepare_corpus(testkg.articles(spark, sf_dir), catalog)
    ge, gv = testkg.gold(spark, sf_dir)
    return Corpus(t, ty, catalog, sents, ge, gv)


def labelled_pairs(c: Corpus, spec: RelationSpec, leak_guard: bool = True) -> DataFrame:
    """Known pairs with their labelled sentences."""
    pairs = sup.training_pairs(c.triples, c.types, spec)
    if leak_guard and c.gold_entities is not None:
        pairs = sup.drop_gold(pairs, c.gold_entities.where(F.col("p") == spec.p))
    return sup.label_sentences(pairs, c.sentences, spec, c.stop_words)


def train_models(c: Corpus, spec: RelationSpec, cap: int | None = None, leak_guard: bool = True,
                 crf_iter: int = CRF_ITERATIONS, seed: int = 7) -> Models:
    """Training side of P1/P2: pairs -> labels -> SVM + CRF. ``seed`` draws the
    capped positives and the negatives."""
    labelled = labelled_pairs(c, spec, leak_guard).persist(StorageLevel.MEMORY_AND_DISK)
    pos = sup.best_positives(labelled, cap, seed).persist(StorageLevel.MEMORY_AND_DISK)
    n_pos = sup.check_enough(pos)
    clf = fit_classifier(c, pos, sup.negatives(labelled), n_pos, cap, seed)
    ext = crf.train(pos, max_iter=crf_iter)
    labelled.unpersist()
    return Models(clf, ext, pos, n_pos)


def fit_classifier(c: Corpus, pos: DataFrame, neg: DataFrame, n_pos: int, cap: int | None, seed: int):
    """As many negatives as positives, the vocabulary, the sentence classifier."""
    vocab = sup.vocabulary(pos, sup.vocabulary_threshold(cap), c.stop_words)
    return classify.train(pos, sup.undersample(neg, n_pos, seed), vocab, stop_words=c.stop_words)


def learning_curve(c: Corpus, spec: RelationSpec, caps=None, seeds=None, crf_iter: int = CRF_ITERATIONS) -> DataFrame:
    """Scores of every (cap, seed): ``(cap, seed, p, tp, fp, fn, precision,
    recall, f_measure)``; ``ev.mean_curve`` averages them. Sentences are labelled
    once; a seed's samples are nested; all extractors are fitted together, one
    pass over the union of the samples an iteration. A cap beyond the pairs there
    are uses them all; a sample that is too small raises ``TooFewExamples``."""
    caps, seeds = list(caps or LEARNING_CURVE_CAPS), list(range(LEARNING_CURVE_RUNS) if seeds is None else seeds)
    checkpoint_dir(c.sentences.sparkSession)
    labelled = labelled_pairs(c, spec).checkpoint()
    samples = sup.nested_samples(sup.best_positives(labelled), caps, seeds).checkpoint()
    number = {(cap, seed): i for i, (cap, seed) in enumerate((cap, seed) for cap in caps for seed in seeds)}
    of = F.create_map(*[F.lit(x) for (cap, seed), i in number.items() for x in (f"{cap} {seed}", i)])
    # a sentence once, with the models it trains
    shared = samples.groupBy("s", "o", "sent_id").agg(F.first("words").alias("words"), F.first("values").alias("values"),
                                                      F.collect_set(F.element_at(of, F.concat_ws(" ", "cap", "seed"))).alias("models"))
    extractors = crf.train_many(shared, max_iter=crf_iter)
    out = None
    for (cap, seed), i in number.items():
        pos = samples.where((F.col("cap") == cap) & (F.col("seed") == seed)).drop("cap", "seed")
        n_pos = sup.check_enough(pos, min(10, cap - 1))
        clf = fit_classifier(c, pos, sup.negatives(labelled), n_pos, cap, seed)
        s, _, _ = evaluate_relation(c, spec, Models(clf, extractors[i], pos, n_pos))
        s = s.select(F.lit(cap).alias("cap"), F.lit(seed).alias("seed"), *s.columns)
        out = s if out is None else out.unionByName(s)
    return out


def extract_values(c: Corpus, spec: RelationSpec, m: Models, entities: DataFrame) -> DataFrame:
    """I15 over candidate entities: ``(entity, value)``."""
    names = entities.select(F.col(entities.columns[0]).alias("title")).distinct()
    sents = c.sentences.join(names, "title", "left_semi")
    kept = classify.select_sentences(m.classifier, sents, stop_words=c.stop_words)
    tagged = crf.tag(m.extractor, kept.select(F.col("title").alias("entity"), "sent_id", "words"))
    spans = extract.spans(tagged, spec)
    obj_types = cat.predominant_types(c.triples, c.types, spec, subject=False)
    return extract.select_values(spans, spec, c.catalog, obj_types)


def enrich(c: Corpus, spec: RelationSpec, m: Models | None = None, out: str | None = None,
           limit: int | None = None) -> DataFrame:
    """Candidates -> values -> N-Triples lines (written when ``out``)."""
    m = m or train_models(c, spec, leak_guard=False)
    cands = cat.candidates(c.triples, c.types, spec, limit)
    values = extract_values(c, spec, m, cands)
    lines = ntriples.ntriple_lines(values, spec.p, spec.is_numeric)
    if out:
        ntriples.write_ntriples(lines, out)
    return lines


def evaluate_relation(c: Corpus, spec: RelationSpec, m: Models | None = None, cap: int | None = None,
                      seed: int = 7):
    """Evaluate on the gold entities -> ``(scores, error table, values)``."""
    m = m or train_models(c, spec, cap=cap, seed=seed)
    ents = c.gold_entities.where(F.col("p") == spec.p).select("entity")
    values = extract_values(c, spec, m, ents)
    s, table = ev.evaluate(c.gold_entities, c.gold_values, values, spec.p)
    return s, table, values


def run(c: Corpus, specs, mode: str = "evaluate", out_dir: str | None = None) -> DataFrame | list:
    """The relation loop with the mode switch."""
    results = []
    for spec in specs:
        if mode == "evaluate":
            s, _, _ = evaluate_relation(c, spec)
            results.append(s)
        else:
            out = os.path.join(out_dir, f"triples-{spec.p}") if out_dir else None
            results.append(enrich(c, spec, out=out))
    if mode == "evaluate":
        u = results[0]
        for r in results[1:]:
            u = u.unionByName(r)
        return u
    return results
