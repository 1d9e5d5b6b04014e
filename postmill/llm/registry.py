"""The queries of the training-data operators, and their SQL where SQL can express them."""

from . import decontaminate, embedding_dedup, exact_dedup, fill_in_middle, filter_audit, language, language_model, packing, simhash, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_simhash": simhash.op3_simhash,
    "op4_language_model": language_model.op4_language_model,
    "op5_token_files": token_files.op5_token_files,
    "op6_packing": packing.op6_packing,
    "op7_language": language.op7_language,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_embedding_dedup": embedding_dedup.op11_embedding_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
