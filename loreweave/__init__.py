"""Memory analytics as Spark plans: retrieval, temporal graph, text pipelines and governance over session memory."""
