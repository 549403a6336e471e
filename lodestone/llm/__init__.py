"""Training-data operators: mixing, extraction, dedup, sharding, language, search, decontamination, secrets."""
