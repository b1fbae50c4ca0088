"""Benchmark: headline queries and pipeline stages at ``$BENCH_SF_DIR``.

Prints ONE JSON line:
  {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...,
   "rows": {...}, "rows_per_sec": {...}, "quality": {...}, "cpus": ...}

Queries are forced with a ``noop`` write (full computation, nothing
collected). Pipeline stages: ``prepare`` (clean + split + tokenise + tag the
derived articles, checkpointed), ``label_<p>`` (training pairs, labelled
sentences, best positives, undersampling, vocabulary), ``svm_<p>``,
``crf_<p>`` and ``extract_<p>`` (score + tag + decode + select + evaluate
over the held-out entities' sentences).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kgenrich.operators import classify, crf, supervise as sup  # noqa: E402
from kgenrich.plans import jobs, registry, testkg  # noqa: E402
from kgenrich.session import get_spark  # noqa: E402

HEADLINE = ["c1_triple_pattern", "c5_type_not_in_relation", "c7_distinct_subjects",
            "d1_catalog", "d7_candidates", "e5_wrapper_tags", "e13_named_entities",
            "e22_clean_articles", "f1_sentences_tokens", "f12_numeric_values"]


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark("bench", cpus=cpus)
    times, rows, quality = {}, {}, {}

    for name in HEADLINE:
        t0 = time.time()                # building the plan may run small jobs
        df = registry.QUERIES[name](spark, sf_dir)
        _noop(df)
        times[name] = round(time.time() - t0, 3)

    t0 = time.time()
    corpus = jobs.demo_corpus(spark, sf_dir)          # checkpointed sentences
    times["prepare"] = round(time.time() - t0, 3)
    rows["prepare"] = corpus.sentences.count()

    for p in ["nation", "balance"]:
        spec = testkg.relation(p)
        t0 = time.time()
        pairs = sup.drop_gold(sup.training_pairs(corpus.triples, corpus.types, spec),
                              corpus.gold_entities.where(F.col("p") == p))
        labelled = sup.label_sentences(pairs, corpus.sentences, spec) \
            .persist(StorageLevel.MEMORY_AND_DISK)
        rows[f"label_{p}"] = labelled.count()
        pos = sup.best_positives(labelled).persist(StorageLevel.MEMORY_AND_DISK)
        n_pos = sup.check_enough(pos)
        neg = sup.undersample(sup.negatives(labelled), n_pos)
        vocab = sup.vocabulary(pos, sup.vocabulary_threshold(None))
        times[f"label_{p}"] = round(time.time() - t0, 3)
        t0 = time.time()
        clf = classify.train(pos, neg, vocab)
        times[f"svm_{p}"] = round(time.time() - t0, 3)
        rows[f"svm_{p}"] = 2 * n_pos
        t0 = time.time()
        ext = crf.train(pos)
        times[f"crf_{p}"] = round(time.time() - t0, 3)
        rows[f"crf_{p}"] = n_pos
        models = jobs.Models(clf, ext, pos, n_pos)
        t0 = time.time()
        scores, _, values = jobs.evaluate_relation(corpus, spec, models)
        s = scores.first()
        times[f"extract_{p}"] = round(time.time() - t0, 3)
        rows[f"extract_{p}"] = corpus.sentences.join(
            corpus.gold_entities.where(F.col("p") == p).select(F.col("entity").alias("title")),
            "title", "left_semi").count()
        labelled.unpersist()
        quality[p] = {"precision": round(s.precision, 4), "recall": round(s.recall, 4),
                      "f_measure": round(s.f_measure, 4), "tp": s.tp, "fp": s.fp, "fn": s.fn}

    total = round(sum(times.values()), 3)
    rps = {k: round(rows[k] / times[k], 1) for k in rows if times.get(k)}
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "rows": rows, "rows_per_sec": rps, "quality": quality,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
