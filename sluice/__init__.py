"""Content-safety and usage analytics over LLM traffic as Spark DataFrame transforms."""
