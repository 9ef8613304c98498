"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, exact_dedup, licenses, main_text, manifest, minhash, packing, prefix_trie, quality, secrets, tokens, toxicity, warc
from .common import table


def op1_secret_scan(spark, sf_dir):
    return secrets.op1_secret_scan(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark, sf_dir):
    return main_text.op2_html_extraction(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.op3_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark, sf_dir):
    return quality.op4_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark, sf_dir):
    return licenses.op6_license_scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark, sf_dir):
    return warc.op8_warc(table(spark, sf_dir, "pages"))


def op9_minhash(spark, sf_dir):
    return minhash.op9_minhash(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.op10_best_fit_packing(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.op11_prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest.op12_merkle_manifest(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.op13_exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_minhash": op9_minhash,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLE = {"op3_decontaminate": decontaminate.SQL, "op8_warc": warc.SQL, "op9_minhash": minhash.SQL,
          "op11_prefix_trie": prefix_trie.SQL, "op12_merkle_manifest": manifest.SQL, "op13_exact_dedup": exact_dedup.SQL}
