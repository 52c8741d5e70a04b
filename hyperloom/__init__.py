"""hyperloom: hypergraph analytics and relational linear algebra on Spark DataFrames."""
