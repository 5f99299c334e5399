"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from ledgerflow.llm import collocations, decontaminate, html_text, katz, license_scan, merkle, packing, quality, sharding, simhash, token_counts, url_filter, vector_join

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_packing": packing.query,
    "op7_quality": quality.query,
    "op8_decontamination": decontaminate.query,
    "op10_html_text": html_text.query,
    "op4_katz": katz.query,
    "op5_vector_join": vector_join.query,
    "op6_simhash": simhash.query,
    "op3_url_filter": url_filter.query,
    "op9_sharding": sharding.query,
    "op11_collocations": collocations.query,
    "op12_merkle": merkle.query,
    "op13_token_counts": token_counts.query,
}

SQL: dict[str, str] = {
    "op5_vector_join": vector_join.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op12_merkle": merkle.SQL,
}
