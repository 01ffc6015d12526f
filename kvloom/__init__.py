"""Key-value, document and replicated-table workloads on PySpark DataFrames."""
