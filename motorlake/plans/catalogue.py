"""Imports every module that registers queries."""

from motorlake.plans import build_queries, catalog_queries, estimate_queries, extract_queries, listing_queries, market_queries, matching_queries, page_queries, resolver_queries, search_queries, showcase_queries, stream_queries, text_queries, upkeep_queries  # noqa: F401
