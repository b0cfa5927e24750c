"""A training corpus from ``documents``, in five stages that each call one operator of ``tidewire.llm``.

Every stage works on all rows that the one before it kept. Its result is written as Parquet to the folder that the executors share and read
again as the next one's input, so a lost executor costs no earlier stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from tidewire.llm import decontamination as _decontamination
from tidewire.llm import minhash as _minhash
from tidewire.llm import mixing as _mixing
from tidewire.llm import token_ids as _token_ids
from tidewire.llm import toxicity as _toxicity
from tidewire.llm._shared import drop, table


def toxicity(spark, docs, sf_dir):
    """Documents whose score is at the threshold or over go; the model learns from ``labels``."""
    return _toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """The least doc_id of each group of near copies stays."""
    return _minhash.dedup(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents in which an item of ``benchmark`` occurs go."""
    return _decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark, docs, sf_dir):
    """Documents are sampled to the target shares of sources, languages and topics."""
    return _mixing.mix(docs)


def token_ids(spark, docs, sf_dir):
    """What is left is written as token ids and read back: doc_id, start, n_tokens, ids_crc32."""
    return _token_ids.token_ids(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]
#: SQL can express none of the model, the sketches or the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
