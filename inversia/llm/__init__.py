"""Operators for preparing training text, each over whole tables of documents.

Nothing outside this package imports it. Operators take DataFrames and name their columns by
parameter; further columns of the input, whatever their names, are carried or left alone as each
docstring says. Intermediate tables go to the folder of ``spark.checkpoint.dir``."""
