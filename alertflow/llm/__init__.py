"""Training-data operators: deduplication, tokens, decontamination, language, packing, licences."""
