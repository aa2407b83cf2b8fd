"""webloom: analytics over stored web pages and text corpora, built on Spark DataFrames."""
