"""Readers and writers: Turtle, benchmark items, predictions, term lists, score files."""
