"""Operators over tables of documents, sections, chunks, vectors, questions and answers."""
