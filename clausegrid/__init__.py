"""clausegrid: a PySpark-native engine for analysing technical and legal documents."""
