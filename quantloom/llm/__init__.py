"""Training-data operators: secrets, mixing, packing, language, licenses, near-duplicates, links, media, toxicity."""
