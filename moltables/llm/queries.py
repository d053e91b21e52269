"""All queries of this folder, each beside its operator, and the SQL they must equal."""

from moltables.llm import filter_audit, gru_lm, html_main, langid, merkle, mixing, mpeg_audio, ngram_join, pii, quality, sharding, spm, token_files  # noqa: F401
from moltables.llm.common import ORACLES, QUERIES  # noqa: F401
