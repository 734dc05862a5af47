"""Corpus statistics, duplicates, packing, mixing and labelling for training data."""
