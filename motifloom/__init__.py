"""Pattern mining over Spark DataFrames: sequences, itemsets, itemset sequences and labelled subgraphs."""
