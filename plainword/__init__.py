"""Lexical normalisation of short noisy texts on Spark."""
