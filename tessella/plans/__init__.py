"""All registered queries: importing the package fills queries.QUERIES and queries.ORACLES."""

from . import queries, scoring, puzzles, measures, whole_pairs  # isort: skip - whole_pairs comes last: it repeats what the others register

__all__ = ["measures", "puzzles", "queries", "scoring", "whole_pairs"]
