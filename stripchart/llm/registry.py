"""The queries of this subpackage."""

from stripchart.llm import ann, bpe, idfile, langid, media, packing, phrases, repeats, secrets, sharding, simhash, variants, warc

QUERIES = {
    "op1_mixture": langid.op1_mixture,
    "op2_trie_join": simhash.op2_trie_join,
    "op3_content_addressed": warc.op3_content_addressed,
    "op4_virtual_slots": sharding.op4_virtual_slots,
    "op5_png_cosine": media.op5_png_cosine,
    "op6_ownership": secrets.op6_ownership,
    "op7_multi_index": ann.op7_multi_index,
    "op8_backtracking_bpe": bpe.op8_backtracking_bpe,
    "op9_ranked_bytes": idfile.op9_ranked_bytes,
    "op10_sum_of_squares": packing.op10_sum_of_squares,
    "op11_interval_expansion": repeats.op11_interval_expansion,
    "op12_pivot_partitioning": phrases.op12_pivot_partitioning,
    "op13_errata_trie": variants.op13_errata_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_content_addressed": warc.OP3_SQL,
    "op11_interval_expansion": repeats.OP11_SQL,
    "op12_pivot_partitioning": phrases.OP12_SQL,
    "op13_errata_trie": variants.OP13_SQL,
}
