"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can express them."""

from . import bpe, language_id, mixing, mpeg_audio, near_duplicates, quality_classifier, quality_rules, substring_dedup, token_counts, warc
from .oracles import MIXING, NEAR_DUPLICATES, QUALITY_RULES, SUBSTRING_DEDUP, WARC

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_mixing": mixing.query,
    "op4_warc": warc.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_language_id": language_id.query,
    "op7_mpeg_audio": mpeg_audio.query,
    "op8_near_duplicates": near_duplicates.query,
    "op9_quality_rules": quality_rules.query,
    "op10_bpe": bpe.query,
}
ORACLES = {"op2_substring_dedup": SUBSTRING_DEDUP, "op3_mixing": MIXING, "op4_warc": WARC, "op8_near_duplicates": NEAR_DUPLICATES, "op9_quality_rules": QUALITY_RULES}
