"""Marlstone: a compact SQL database experience on PySpark DataFrames."""
