"""tidemark: incremental data-quality analytics over edit histories, on Spark."""
