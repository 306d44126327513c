"""Importing this module registers every query of the subpackage."""

from tidewatch.llm import ann, audit, bpe, chat, covertree, decontam, langid, lm, merkle, pii, secrets, setjoin, tokencount  # noqa: F401
