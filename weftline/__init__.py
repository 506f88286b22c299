"""weftline: Spark-first operators over ordered sequences, graphs, text and geometry."""
