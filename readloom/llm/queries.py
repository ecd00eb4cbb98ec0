"""Registered queries of the operators, and their SQL where SQL can say them."""

from . import chat, decontaminate, embeddings, katz, license, linedup, mixture, quality, simhash, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_license_scan": license.op3_license_scan,
    "op4_simhash": simhash.op4_simhash,
    "op5_katz": katz.op5_katz,
    "op6_mixture": mixture.op6_mixture,
    "op7_chat_format": chat.op7_chat_format,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_dedup": linedup.op9_line_dedup,
    "op10_quality": quality.op10_quality,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_embeddings": embeddings.OP2_SQL,
    "op6_mixture": mixture.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op9_line_dedup": linedup.OP9_SQL,
}
