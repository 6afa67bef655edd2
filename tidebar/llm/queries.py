"""The queries of this subpackage and their SQL, for __spark_entry__."""

from . import bpe, centroids, fingerprints, jaccard, langid, packing, pieces, quality, resampling, sharding, substrings, toxicity, wrappers

MODULES = (langid, toxicity, fingerprints, wrappers, sharding, quality, substrings, bpe, packing, jaccard, pieces, resampling, centroids)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
