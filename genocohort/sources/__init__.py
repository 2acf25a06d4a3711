"""Readers of genotype, sequence and reference files as many-file Spark jobs, and writers."""
