"""Training-data operators: language ID, near-dedup, decontamination, PII, packing, scoring, extraction, binary output."""
