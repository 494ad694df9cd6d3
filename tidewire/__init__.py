"""tidewire: news intelligence jobs as Spark DataFrame and Structured Streaming pipelines."""
