"""Part of quern, corpus analytics on Spark."""
