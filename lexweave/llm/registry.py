"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, embedding, fingerprint, html, langid, minhash, mixing, substring, tokens, toxicity

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op9_embedding": embedding.op9_embedding,
    "op10_substring": substring.op10_substring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op2_langid": langid.op2_langid,
    "op3_html": html.op3_html,
    "op4_fingerprint": fingerprint.op4_fingerprint,
    "op5_tokens": tokens.op5_tokens,
    "op6_bpe": bpe.op6_bpe,
}

ORACLES: dict[str, str] = {
    "op1_minhash": minhash.SQL,
    "op9_embedding": embedding.SQL,
    "op10_substring": substring.SQL,
}
