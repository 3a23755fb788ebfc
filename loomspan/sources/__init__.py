"""Readers and writers: source trees, question and answer files, stored entities."""
