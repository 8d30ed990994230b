"""tidemark: change capture, migration and verification of document collections on Spark DataFrames."""

__version__ = "0.1.0"
