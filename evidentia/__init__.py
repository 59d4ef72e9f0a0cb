"""Evaluation of retrieval-augmented question answering as Spark dataflows."""
