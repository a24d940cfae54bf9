"""Corpus operators for training-data pipelines. Nothing else in packlens imports this package."""
