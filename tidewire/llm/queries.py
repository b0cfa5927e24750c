"""Registered queries of this subpackage and of the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib


def _late(module: str, name: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(module), name)(spark, sf_dir)


NAMES = {
    "op1_secret_scan": "secrets",
    "op2_minhash_dedup": "minhash",
    "op3_embedding_dedup": "hnsw",
    "op4_line_dedup": "line_dedup",
    "op5_decontamination": "decontamination",
    "op6_lm_scoring": "suffix_tree",
    "op7_mixing": "mixing",
    "op8_toxicity": "toxicity",
    "op10_quality": "quality",
    "op9_token_ids": "token_ids",
}


def queries() -> dict:
    found = {name: _late(f"tidewire.llm.{module}", name) for name, module in NAMES.items()}
    return found | {"pipeline": _late("corpus_pipeline", "run")}


def oracle_sql() -> dict:
    return {"op4_line_dedup": importlib.import_module("tidewire.llm.line_dedup").SQL}
