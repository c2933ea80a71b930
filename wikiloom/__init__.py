"""wikiloom: wiki catalogues and query routing as Spark DataFrame jobs."""
