"""quillstone: a PySpark-native engine for decision-data curation and evaluation."""
