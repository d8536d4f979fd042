"""Operators for preparing language-model training text: cleaning, dedup, formatting, packing, archives."""
