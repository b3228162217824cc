"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import classifier, html_text, kdtree, mixing, packing, quality_rules, secrets, simhash, token_counts, token_files

QUERIES = {
    "op1_packing": packing.query,
    "op2_simhash": simhash.query,
    "op3_classifier": classifier.query,
    "op4_token_counts": token_counts.query,
    "op5_quality_rules": quality_rules.query,
    "op6_mixing": mixing.query,
    "op7_kdtree": kdtree.query,
    "op8_html": html_text.query,
    "op9_token_files": token_files.query,
    "op10_secrets": secrets.query,
}
ORACLES = {"op6_mixing": mixing.ORACLE, "op7_kdtree": kdtree.ORACLE}
