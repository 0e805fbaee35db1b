"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pitchframe.llm.decontaminate import op10_decontaminate
from pitchframe.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from pitchframe.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from pitchframe.llm.lexical_search import OP13_SQL, op13_lexical_search
from pitchframe.llm.license_scan import OP1_SQL, op1_license_scan
from pitchframe.llm.quality import op2_quality
from pitchframe.llm.quality_rules import OP11_SQL, op11_quality_rules
from pitchframe.llm.repeats import op8_repeats
from pitchframe.llm.simhash import op4_simhash
from pitchframe.llm.source_mix import OP3_SQL, op3_source_mix
from pitchframe.llm.token_planes import op7_token_planes
from pitchframe.llm.url_filter import OP9_SQL, op9_url_filter
from pitchframe.llm.warc import op6_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality,
        op3_source_mix,
        op4_simhash,
        op5_exact_dedup,
        op6_warc,
        op7_token_planes,
        op8_repeats,
        op9_url_filter,
        op10_decontaminate,
        op11_quality_rules,
        op12_hard_negatives,
        op13_lexical_search,
    )
}
SQL = {
    "op1_license_scan": OP1_SQL,
    "op3_source_mix": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op9_url_filter": OP9_SQL,
    "op11_quality_rules": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
