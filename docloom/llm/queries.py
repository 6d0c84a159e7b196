"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, language, licenses, mixing, pieces, simhash, substring_dedup, toxicity, transport, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        transport.op1_transport_stream,
        exact_dedup.op2_content_sort,
        url_filter.op3_url_trees,
        licenses.op4_license_windows,
        pieces.op5_pieces,
        mixing.op6_temperature,
        simhash.op7_simhash,
        substring_dedup.op8_relative_factors,
        toxicity.op9_kneser_ney,
        language.op10_language,
    )
}
SQL = {"op2_content_sort": exact_dedup.SQL, "op8_relative_factors": substring_dedup.SQL}
