"""The registered queries of this folder and their SQL."""

import public_tokenizers

from factgraph.llm import bpe, chat, classifier, decontamination, pii, quality, resampling, secrets, sharding, simhash, substrings, urls, variants
from factgraph.runtime import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_chat_formatting(spark, sf_dir):
    """All conversations and the probe, formatted in budgeted windows and read back; null texts are empty, null turns come first."""
    return chat.op1(table(spark, sf_dir, "conversations"))


def op2_byte_level_bpe(spark, sf_dir):
    """Every whole text encoded and decoded again, with digests of both; null texts are empty, repeated rows stay."""
    path = public_tokenizers.path(RANKS)
    ids = bpe.bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, packed=True)
    return bpe.digests(bpe.bpe_decode(ids, path))


def op3_simhash_near_dedup(spark, sf_dir):
    """Every document's fingerprint and the least doc_id it is linked with; null texts have fingerprint zero."""
    return simhash.op3(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    """Base counts and verdicts of every whole text, by a classifier that is fitted on labelled rows; null texts fail."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model)


def op5_pii(spark, sf_dir):
    """Personal data in every whole text: the base patterns' spans and those that the field adds; null texts have none."""
    return pii.op5(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark, sf_dir):
    """Regions of every whole text that hold a benchmark window within the edit budget; null texts have none."""
    return decontamination.contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filters(spark, sf_dir):
    """Every page's host, path, longest rule that fits, and verdict; null URLs have an empty host and path."""
    return urls.op7(table(spark, sf_dir, "pages"))


def op8_sharding(spark, sf_dir):
    """Every document's shard and slot along the Hilbert curve; null texts have 8 bytes, repeated rows a slot each."""
    return sharding.op8(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    """Every document without the words of windows that start earlier in the corpus; null texts have no words."""
    return substrings.op9(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark, sf_dir):
    """Secrets in every whole text: the base patterns' spans and parsed structures; null texts have none."""
    return secrets.op10(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    """Every document's n-gram weight towards the benchmark texts, its score, and its rank if it is among the 5 % drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark, sf_dir):
    """Every frequent word with its number of near words, its form and its root."""
    return variants.grouped(table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark, sf_dir):
    """Every document's quality score, learnt from the labelled rows that are not held out."""
    return classifier.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_byte_level_bpe, op3_simhash_near_dedup, op4_quality_rules, op5_pii,
    op6_benchmark_decontamination, op7_url_filters, op8_sharding, op9_substring_dedup, op10_secret_scans,
    op11_importance_resampling, op12_spelling_variants, op13_quality_classifier)}
SQL = {"op7_url_filters": urls.OP7_SQL}
