"""The registered queries of the training-data operators."""

from __future__ import annotations

from terravane.llm import bpe, filter_audit, fingerprint, language, lattice, mixing, near_dup, ppm, quality, site_tree, suffix_dedup, url_filter, whitening
from terravane.llm.common import table


def op1_source_mix(spark, sf_dir):
    """Mix all documents to source weights."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lattice(spark, sf_dir):
    """Near-duplicate components of all embeddings."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark, sf_dir):
    """Judge every page's url by rules and the character models."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_suffix_index(spark, sf_dir):
    """Remove bytes of repeated 200-byte strings from every document."""
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark, sf_dir):
    """Quality scores of all documents by the rule ensemble."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_ppm(spark, sf_dir):
    """Scores of all documents by the byte-context model and the unigram baseline."""
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_winnowing(spark, sf_dir):
    """Fingerprint every document and its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    """Encode and decode every document with a public vocabulary."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_byte_cnn(spark, sf_dir):
    """Languages of all documents by the byte network."""
    return language.identify(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    """What five filters remove in each order, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark, sf_dir):
    """Whitened components of all usable embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_site_tree(spark, sf_dir):
    """Main text of every page."""
    return site_tree.extract(table(spark, sf_dir, "pages"))


QUERIES = (op1_source_mix, op2_lattice, op3_url_filter, op4_suffix_index, op5_rule_ensemble, op6_minhash, op7_ppm, op8_winnowing, op9_bpe, op10_byte_cnn, op11_filter_audit, op12_whitening, op13_site_tree)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op1_source_mix": mixing.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
