"""Operators for training-data pipelines: packing, quality, dedup, decontamination, WARC, sharding, licences."""
