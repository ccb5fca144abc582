"""Corpus preparation at scale: packing, deduplication, decontamination, mixing, scans, extraction."""
