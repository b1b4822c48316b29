"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from plotwise.llm.bpe import op3_bpe
from plotwise.llm.conversation_repair import op11_conversation_repair
from plotwise.llm.edit_dups import op5_edit_dups
from plotwise.llm.embedding_dups import op4_embedding_dups
from plotwise.llm.fingerprints import op7_fingerprints
from plotwise.llm.hard_negatives import SQL as HARD_NEGATIVES_SQL
from plotwise.llm.hard_negatives import op12_hard_negatives
from plotwise.llm.language_model import op9_language_model
from plotwise.llm.packing import op10_packing
from plotwise.llm.personal_data import op8_personal_data
from plotwise.llm.quality import op2_quality
from plotwise.llm.secrets import op6_secrets
from plotwise.llm.token_files import op1_token_files
from plotwise.llm.toxicity import op13_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_quality, op3_bpe, op4_embedding_dups, op5_edit_dups, op6_secrets, op7_fingerprints, op8_personal_data, op9_language_model, op10_packing, op11_conversation_repair, op12_hard_negatives, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": HARD_NEGATIVES_SQL}
