"""Relational operators over alignments, fragments, molecules and intervals."""
