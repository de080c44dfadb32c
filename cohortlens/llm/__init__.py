"""Training-data operators. Nothing else in the library imports this subpackage."""

from . import audit, bpe, chat, contamination, cotraining, jaccard, lines, merges, quality, repair, secrets, suffixes, warc  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
