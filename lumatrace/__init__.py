"""lumatrace: analytics of per-molecule time traces, and a toolkit for text corpora, on Spark DataFrames."""
