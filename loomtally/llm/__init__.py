"""Training-data operators over large document tables.

Nothing outside this subpackage imports it; ``queries`` holds the registry that
``__spark_entry__.py`` adds when the subpackage is present.
"""
