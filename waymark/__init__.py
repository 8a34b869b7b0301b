"""Spark jobs for location-based business recommendation data.

``functions``  column expressions (no DataFrame in, no DataFrame out)
``sources``    readers, writers and the sample views over the test tables
``operators``  DataFrame-to-DataFrame building blocks
``plans``      operators composed into the registered queries
``streaming``  continuous ingest and running preferences
"""
