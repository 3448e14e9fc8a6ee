"""Operators of a training-data pipeline: packing, byte-level BPE, quality
rules, URL filters, fingerprints, near-duplicates, toxicity, secrets, WARC,
sharding, whitening, exact duplicates and Merkle manifests. Nothing else in the library imports this subpackage."""
