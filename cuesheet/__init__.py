"""cuesheet: Spark-native analytics over time-stamped transcripts and the operational data around them."""
