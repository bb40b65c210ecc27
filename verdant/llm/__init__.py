"""Training-data operators (the numbered ``opN_*`` queries).

Nothing outside this folder imports it; ``__spark_entry__`` adds
``registry.QUERIES`` / ``registry.SQL`` when the folder is there.
"""
