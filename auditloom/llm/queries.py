"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools

from auditloom.llm.op01_warc import ORACLE as OP1
from auditloom.llm.op01_warc import op1_warc
from auditloom.llm.op02_suffix_dedup import op2_suffix_dedup
from auditloom.llm.op03_minhash import op3_minhash
from auditloom.llm.op04_exact_dedup import ORACLE as OP4
from auditloom.llm.op04_exact_dedup import op4_exact_dedup
from auditloom.llm.op05_embeddings import op5_embeddings
from auditloom.llm.op06_mixing import op6_mixing
from auditloom.llm.op07_byte_bpe import op7_byte_bpe
from auditloom.llm.op08_token_counts import op8_token_counts
from auditloom.llm.op09_sharding import op9_sharding
from auditloom.llm.op10_toxicity import op10_toxicity
from auditloom.session import ship_package



def _shipped(query):
    """The query, with the package sent to the executors first."""

    @functools.wraps(query)
    def run(spark, sf_dir: str):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash": op3_minhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_embeddings": op5_embeddings,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
}
QUERIES = {name: _shipped(query) for name, query in _ALL.items()}
ORACLE = {"op1_warc": OP1, "op4_exact_dedup": OP4}
