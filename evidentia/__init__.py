"""evidentia: evidence-map, record-reconciliation and training-data operators on Spark DataFrames."""
