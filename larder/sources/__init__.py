"""Readers and writers of models, word vectors, food tables and parsed records."""
