"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestone.llm.bpe import op3_bpe
from lodestone.llm.decontam import OP4_SQL, op4_decontamination
from lodestone.llm.itq import OP7_SQL, op7_embeddings
from lodestone.llm.langid import op8_language
from lodestone.llm.licenses import OP5_SQL, op5_licenses
from lodestone.llm.pii import op1_pii
from lodestone.llm.quality import op2_quality
from lodestone.llm.simhash import op10_simhash
from lodestone.llm.toxicity import op9_toxicity
from lodestone.llm.warc import OP6_SQL, op6_warc


def queries() -> dict:
    return {
        "op1_pii": op1_pii,
        "op2_quality": op2_quality,
        "op3_bpe": op3_bpe,
        "op4_decontamination": op4_decontamination,
        "op5_licenses": op5_licenses,
        "op6_warc": op6_warc,
        "op7_embeddings": op7_embeddings,
        "op8_language": op8_language,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op5_licenses": OP5_SQL, "op6_warc": OP6_SQL, "op7_embeddings": OP7_SQL}
