"""The registered queries of the corpus operators."""

from . import sql
from .decontamination import op8_benchmark_decontamination
from .fingerprints import op4_document_fingerprints
from .html_text import op10_html_extraction
from .mixing import op2_source_mixing
from .pii import op7_pii
from .quotation import op3_quotation_linking
from .simhash import op5_simhash_near_dedup
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op1_suffix_array_dedup
from .toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_source_mixing,
        op3_quotation_linking,
        op4_document_fingerprints,
        op5_simhash_near_dedup,
        op6_substring_dedup,
        op7_pii,
        op8_benchmark_decontamination,
        op9_toxicity,
        op10_html_extraction,
    )
}

#: What SQL can state; the others are tested against brute force, held-out labels or fixtures.
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
