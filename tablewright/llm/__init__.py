"""Training-data operators: de-duplication, tokens, mixing, classifiers, search, packing."""
