"""Evidence and risk-signal engine on PySpark DataFrames."""
