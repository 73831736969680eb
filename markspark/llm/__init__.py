"""Training-data operators (numbered ``opN``) and the corpus pipeline's stages.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the package is present.
"""
