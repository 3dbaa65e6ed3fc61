"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from quillon.llm import docpairs, encoding, mixing, neardup, neighbours, parsecheck, provenance, ranking, spam, splitting

QUERIES = {
    "p1_found": parsecheck.p1_found,
    "p1_rates": parsecheck.p1_rates,
    "p2_found": neardup.p2_found,
    "p2_classes": neardup.p2_classes,
    "p2_recall": neardup.p2_recall,
    "p3_found": ranking.p3_found,
    "p4_found": neighbours.p4_found,
    "p4_recall": neighbours.p4_recall,
    "p4_recall_wiki": neighbours.p4_recall_wiki,
    "p5_found": docpairs.p5_found,
    "p5_pairs": docpairs.p5_pairs,
    "p5_pairs_of_files": docpairs.p5_pairs_of_files,
    "p6_found": provenance.p6_found,
    "p6_kinds": provenance.p6_kinds,
    "p7_found": splitting.p7_found,
    "p8_ids": encoding.p8_ids,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p9_shares_out_of_reach": mixing.p9_shares_out_of_reach,
    "p10_found": spam.p10_found,
    "p10_host_rates": spam.p10_host_rates,
}

SQL: dict[str, str] = {
    "p2_found": neardup.P2_SQL,
    "p3_found": ranking.P3_SQL,
    "p7_found": splitting.P7_SQL,
}
