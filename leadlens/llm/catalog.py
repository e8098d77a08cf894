"""The registered queries of this folder and their SQL, where SQL can express them."""

from __future__ import annotations

from . import (chat, decontaminate, exact_dedup, minhash, negatives, packing, pii, quality, substrings, token_output, topk, urls,
               whitening)

QUERIES = {
    "op1_token_output": token_output.query,
    "op2_quality": quality.query,
    "op3_chat_format": chat.query,
    "op4_top_k": topk.query,
    "op5_substrings": substrings.query,
    "op6_packing": packing.query,
    "op7_decontaminate": decontaminate.query,
    "op8_url_filter": urls.query,
    "op9_pii": pii.query,
    "op10_near_duplicates": minhash.query,
    "op11_whitening": whitening.query,
    "op12_hard_negatives": negatives.query,
    "op13_exact_dedup": exact_dedup.query,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat.SQL,
    "op4_top_k": topk.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
