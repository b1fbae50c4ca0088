"""kgenrich: knowledge-graph enrichment by distant supervision on Spark.

sources/    scans and sinks (N-Triples, XML dump, gold sets, tagged corpora)
functions/  Column -> Column expressions (IRIs, values, markup, tags)
operators/  DataFrame -> DataFrame operators (graph, catalog, text,
            supervision, classifier, CRF, extraction, evaluation, paper ops)
plans/      end-to-end jobs, the test-data adapter, registered queries
streaming/  incremental article preparation (Structured Streaming)
"""

__version__ = "0.1.0"
