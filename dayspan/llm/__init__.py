"""Training-data operators: dedup, decontamination, language, quality, LM, secrets, mixing and token output."""
