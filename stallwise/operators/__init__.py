"""Reusable distributed building blocks: exact ranks, cut points, quantiles, modes."""
