"""sparlane: Spark-native analytics for labelled tables that a variable specification describes.

``operators`` holds DataFrame-to-DataFrame operators, ``functions`` scalar and expression support,
``sources`` readers and writers, ``plans`` the query registry, ``streaming`` micro-batch use of the operators.
"""
