"""Flow-graph analytics on Spark: profiling, audits, splits, encoding, window graphs, evaluation, evidence."""
