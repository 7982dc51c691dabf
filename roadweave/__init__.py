"""Road-network, trace, feed and corpus analytics as PySpark DataFrame operators."""
