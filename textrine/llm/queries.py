"""The queries of this subpackage, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from textrine.llm import decontam, embed_dedup, filter_audit, line_dedup, near_dup, source_divergence, suffix_dedup
from textrine.llm.common import table


def op8_bpe(spark, sf_dir):
    import public_tokenizers

    from textrine.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_license_scan(spark, sf_dir):
    from textrine.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    from textrine.llm.sharding import place

    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op3_html_extraction(spark, sf_dir):
    from textrine.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark, sf_dir):
    from textrine.llm.line_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    from textrine.llm.decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark, sf_dir):
    from textrine.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_fm(spark, sf_dir):
    from textrine.llm.quality_fm import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_near_dup(spark, sf_dir):
    from textrine.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    from textrine.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embed_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark, sf_dir):
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_fm": op7_quality_fm,
    "op8_bpe": op8_bpe,
    "op9_near_dup": op9_near_dup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_embed_dedup": op12_embed_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_decontamination": decontam.ORACLE,
    "op9_near_dup": near_dup.ORACLE,
    "op10_suffix_dedup": suffix_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_embed_dedup": embed_dedup.ORACLE,
    "op13_source_divergence": source_divergence.ORACLE,
}
