"""moodspark: sentiment analytics over short-text tables, expressed as Spark jobs.

Layout
------
``functions``  column expressions (text cleaning, label maps, score vectors)
``sources``    table readers, column resolution, sinks
``operators``  DataFrame -> DataFrame operators (filters, dedupe, sampling,
               features, lexicon scoring, statistics, evaluation, ensembles)
``plans``      composed jobs (training, model comparison, batch scoring) and the
               query catalogue used by ``__spark_entry__``
``streaming``  Structured Streaming scoring
"""

__version__ = "0.1.0"
