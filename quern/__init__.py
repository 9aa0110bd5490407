"""quern: label and corpus analytics expressed as Spark DataFrames."""
