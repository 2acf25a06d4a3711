"""A PySpark-native analytics engine for cohorts of genotype calls."""
