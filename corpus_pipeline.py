"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept. All but
the last return the columns of documents, whatever others a table has beside the five, under any names.
Empty tables give empty tables at every stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.llm import bpe, decontaminate, langid, secrets, simhash
from evidra.llm._common import discard, materialize, settle, settle_executors, table
from evidra.llm.queries import BPE_FILE, bpe_pattern, tokenizer_file
from evidra.session import ship


def _begin(spark):
    """JVMs give back what the stage before left, so that they don't hold it beside this one's Python workers."""
    settle(ship(spark))
    settle_executors(spark)


def identify_language(spark, docs, sf_dir):
    """Documents whose language is rejected go.

    Null texts and texts without a letter are rejected; short ones are judged like long ones but for
    the learned limits. Repeated rows are kept or go together.
    """
    _begin(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8) stays, the one with the smallest id.

    Texts of fewer words have one shingle, the whole; texts without words are alike. Repeated rows of
    an id are one document; rows with a null id stay.
    """
    _begin(spark)
    return simhash.keep_one_per_component(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that cover a benchmark item go.

    Null and empty texts cover nothing and stay; items and texts of any length are tiled whole.
    """
    _begin(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark, docs, sf_dir):
    """Credentials in the texts are replaced; all documents stay. Owners and repositories are those of op4.

    Null and empty texts stay as they are; equal texts are redacted alike; null sources and languages are
    owners and repositories of their own.
    """
    _begin(spark)
    return secrets.redact_secrets(docs, repo=F.concat_ws("/", "source", "lang"))


def encode_tokens(spark, docs, sf_dir):
    """doc_id, n_tokens and digests of the token ids and of the bytes decoded from them.

    Fewer words are held than in op2, as workers of all stages share the executors' memory. Null and
    empty texts have no tokens; repeated rows have a row each.
    """
    _begin(spark)
    return bpe.token_digests(docs, tokenizer_file(BPE_FILE), bpe_pattern(), common=30_000, most_words=120_000)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("BPE", encode_tokens),
]
#: The stages are models, hashes and tilings that SQL can't express; tests compare each with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        if n:
            discard(before)
    return docs
