"""Training-data operators: text normalisation, de-duplication, packing, encoding.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where the folder is present.
"""
