"""Training-data operators: ten numbered operators over documents, pages and labels.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
