"""millrace: map, partition, sort, reduce and text output as lazy PySpark DataFrames."""
