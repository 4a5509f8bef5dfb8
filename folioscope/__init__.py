"""Spark jobs over bibliographic records and large document collections."""
