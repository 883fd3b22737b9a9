"""prismata: spectral analytics and model auditing as Spark DataFrame operators."""
