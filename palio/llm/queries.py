"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontaminate, forest, lexical, licenses, oracle, outliers, packing, periodic, rangecoder, simhash, substring, suffix, urltree, weaklabel

QUERIES = {
    "op1_robust_outliers": outliers.query,
    "op2_range_coder": rangecoder.query,
    "op3_decontaminate": decontaminate.query,
    "op4_weak_label_classifier": weaklabel.query,
    "op5_best_fit_packing": packing.query,
    "op6_simhash_dedup": simhash.query,
    "op7_url_template_tree": urltree.query,
    "op8_license_scan": licenses.query,
    "op9_suffix_dedup": suffix.query,
    "op10_substring_dedup": substring.query,
    "op11_periodic_runs": periodic.query,
    "op12_best_position_search": lexical.query,
    "op13_lsh_forest_dedup": forest.query,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
