"""siftline: security-findings and corpus analytics on PySpark DataFrames."""
