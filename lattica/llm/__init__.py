"""Operations for preparing training data at scale: filtering, deduplication,
similarity search, tokenisation, packing, scoring and sharding.

Every module here stands alone from the graph engine.
"""
