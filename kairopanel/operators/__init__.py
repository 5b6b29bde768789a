"""Operators on panels: as-of reads, adjustment, rolling features, cross-sections, selection, portfolios, metrics, ratings, statistics."""
