"""skeinwork: dataset-quality and detection-evaluation analytics on PySpark."""
