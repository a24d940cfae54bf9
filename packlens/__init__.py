"""packlens: label-compliance analytics and corpus operators on Spark DataFrames."""
