"""assetlens: a Spark-native engine for asset evidence, wallet behaviour and verdicts."""
