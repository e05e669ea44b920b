"""weftnet: network-flow and network-design analytics on Spark DataFrames."""
