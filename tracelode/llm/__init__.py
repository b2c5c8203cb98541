"""Operators for texts on their way into a training corpus.  Nothing outside imports this."""
