"""Spark jobs for citation, footnote and document-collection data."""
