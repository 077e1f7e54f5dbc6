"""tessera: a Spark-native analytics engine for code graphs and text corpora."""
