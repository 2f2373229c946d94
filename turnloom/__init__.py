"""PySpark-native analytics over keyed, ordered, append-only conversation logs."""
