"""The registered query of each operator, with its check SQL where SQL can express it."""
from . import chat, decontaminate, langid, lines, minhash, packing, pieces, repair, shards, spelling, tokens, vectors, warc

QUERIES = {f.__name__: f for f in (
    minhash.op1_minhash_near_dedup, tokens.op2_token_files, lines.op3_line_dedup, packing.op4_best_fit_packing, chat.op5_chat_formatting,
    decontaminate.op6_benchmark_decontamination, langid.op7_language_id, shards.op8_sharding, vectors.op9_embedding_near_dedup, warc.op10_warc,
    pieces.op11_sentencepiece, spelling.op12_spelling_variants, repair.op13_conversation_repair)}
ORACLES = {
    "op1_minhash_near_dedup": minhash.ORACLE_SQL, "op3_line_dedup": lines.ORACLE_SQL, "op6_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_embedding_near_dedup": vectors.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL,
    "op13_conversation_repair": repair.ORACLE_SQL}
