"""Training-data operators: packing, decontamination, deduplication, scans, sketches, counts, shards, scores, extraction."""
