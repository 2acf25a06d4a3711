"""Operators over DataFrames of calls, findings, frequencies, rules and snapshots."""
