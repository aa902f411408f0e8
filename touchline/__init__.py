"""touchline: spatio-temporal match analytics as PySpark DataFrame operators."""
