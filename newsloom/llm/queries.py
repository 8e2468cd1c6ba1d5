"""All registered operator queries of this folder."""

from newsloom.llm import base, bpe, chat, decontaminate, ngram_join, pii, prefix_trie, pseudo_likelihood, quality, secret_scan, sharding, source_divergence, toxicity, vector_join  # noqa: F401
from newsloom.llm import oracles

base.ORACLES["op1_ngram_jaccard_join"] = oracles.NGRAM_JOIN
base.ORACLES["op3_subspace_pigeonhole_join"] = oracles.VECTOR_JOIN
base.ORACLES["op9_feistel_sharding"] = oracles.shard_sql(sharding.SHARDS, sharding.SEED)
base.ORACLES["op13_length_bucketed_divergence"] = oracles.DIVERGENCE
base.ORACLES["op11_tree_contraction_trie"] = oracles.trie_sql(prefix_trie.FAMILY, prefix_trie.HEADS)

QUERIES, ORACLES = base.QUERIES, base.ORACLES
