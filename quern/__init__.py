"""quern: declarative curation of large text corpora on Spark DataFrames."""
