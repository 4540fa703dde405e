"""Importing this module registers every query of the subpackage."""

from itemspark.llm.registry import ORACLES, QUERIES

from itemspark.llm import (audit, chat, language, media, mixing, packing, periodic, repeats, shards, simhash, tokenfile, topk, warc)  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
