"""Whole jobs over a cohort, the fixture views and the registered queries."""
