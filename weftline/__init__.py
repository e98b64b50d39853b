"""weftline: column-lineage analytics and data-flow execution on Spark DataFrames."""

__version__ = "0.1.0"
