"""Readers, and the tables the rounds write to."""
