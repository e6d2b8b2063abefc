"""The queries of the subpackage and, where SQL expresses them, their SQL."""

from tarnwater.llm import audio, bpe, chat, licenses, mixing, quality, simhash, suffixes, syncmers, toxicity

_MODULES = (syncmers, simhash, mixing, toxicity, suffixes, bpe, licenses, chat, audio, quality)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
