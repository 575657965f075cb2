"""Training-data operators: near duplicates, decontamination, tokens, classifiers, mixing."""
