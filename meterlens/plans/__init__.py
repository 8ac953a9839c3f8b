"""Whole reports: which measures exist for the sources at hand, and how they share rollups."""
