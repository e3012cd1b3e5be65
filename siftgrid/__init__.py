"""siftgrid: exposure analytics over large text tables, as Spark DataFrame jobs."""
