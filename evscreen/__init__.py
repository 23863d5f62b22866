"""Evidence screening by rater ensembles, with statistical self-validation, on Spark DataFrames."""

__version__ = "0.1.0"
