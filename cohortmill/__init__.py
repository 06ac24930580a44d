"""Cohort, molecular-profile and survival analytics on Spark DataFrames."""
