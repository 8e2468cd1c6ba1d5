"""Training-data operators: near duplicates, decontamination, scoring, tokens, personal data, sharding.

Nothing outside this folder imports it; ``__spark_entry__.py`` registers its queries only when it is present.
"""
