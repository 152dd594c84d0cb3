"""Training-data operators: search, packing, chat formatting, mixing, dedup and classifiers."""
