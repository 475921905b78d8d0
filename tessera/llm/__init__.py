"""Operators for large training-data pipelines: packing, toxicity, fingerprints, suffix-array dedup,
bit-sliced top-k, HTML extraction, n-gram Jaccard join, token files, secret scans and source mixing."""
