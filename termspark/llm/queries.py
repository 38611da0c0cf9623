"""The queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termspark.llm import ann, bpe, divergence, langid, licenses, lines, media, mixing, secrets, simhash, substrings, warc, whitening


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_neighbours": ann.op2_neighbours,
    "op3_language": langid.op3_language,
    "op4_warc": warc.op4_warc,
    "op5_media": media.op5_media,
    "op6_secrets": secrets.op6_secrets,
    "op7_bpe": bpe.op7_bpe,
    "op8_lines": lines.op8_lines,
    "op9_substrings": substrings.op9_substrings,
    "op10_mixing": mixing.op10_mixing,
    "op11_licenses": licenses.op11_licenses,
    "op12_divergence": divergence.op12_divergence,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": pipeline,
}
ORACLES = {"op4_warc": warc.ORACLE, "op9_substrings": substrings.ORACLE, "op11_licenses": licenses.ORACLE, "op12_divergence": divergence.ORACLE}
