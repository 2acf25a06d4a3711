"""Column functions: alleles, scoring ladders, population arithmetic."""
