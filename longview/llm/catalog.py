"""The registered queries of this package with their oracle SQL (None where SQL cannot express them)."""

from longview.llm import aligned, chat, decontam, licenses, lines, merkle, ngrams, packing, pages, quality, shards, simhash, urls

GROUPS = (ngrams, simhash, chat, quality, packing, lines, shards, licenses, pages, decontam, merkle, aligned, urls)


def all_queries() -> dict:
    return {name: entry for group in GROUPS for name, entry in group.QUERIES.items()}
