"""Training-data operators: fingerprints, formatting, licence scans, dedup, extraction, packing, classifiers."""
