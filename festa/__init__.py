"""A Spark-native engine that turns regional news into a catalogue of public events."""
