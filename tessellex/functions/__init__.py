"""Column functions: tokenizers, Unicode cleanup, stemmers, and tail probabilities."""
