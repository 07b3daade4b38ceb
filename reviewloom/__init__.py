"""Catalogue-and-review analytics as PySpark DataFrame operators.

The layers, from the bottom up:

* ``functions``  column expressions (strict parsing, n-grams, marker words)
* ``sources``    CSV readers, cleaning with a quarantine, result sinks
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      the five parameterised questions
* ``streaming``  the same operators over Structured Streaming
* ``workload``   bindings of the above to concrete tables, and their SQL twins
"""
