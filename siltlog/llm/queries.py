"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from .decontaminate import OP9_SQL, op9_decontamination
from .dedup import OP2_SQL, op2_exact_dedup
from .jaccard import OP8_SQL, op8_jaccard_join
from .language import op6_language_id
from .licenses import op7_license_scan
from .packing import op1_packing
from .secrets import op5_secret_scan
from .tokencount import op4_token_count
from .toxicity import op3_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_token_count": op4_token_count,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_license_scan": op7_license_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_warc": OP10_SQL}
