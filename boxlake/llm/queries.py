"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express on whole tables."""

from . import exact, lexical, merkle, mixing, secrets, substrings, warc
from .exact import op10_exact_dedup
from .language_model import op11_language_model
from .lexical import op12_lexical_search
from .merkle import op13_merkle_manifest
from .mixing import op7_mixing
from .pieces import op6_sentencepiece
from .pu_quality import op5_pu_quality
from .quality_rules import op4_quality_rules
from .secrets import op3_secrets
from .simhash import op1_simhash
from .substrings import op8_substring_dedup
from .toxicity import op9_toxicity
from .warc import op2_warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_warc, op3_secrets, op4_quality_rules, op5_pu_quality, op6_sentencepiece, op7_mixing, op8_substring_dedup, op9_toxicity, op10_exact_dedup, op11_language_model, op12_lexical_search, op13_merkle_manifest)} | {"pipeline": _pipeline}

ORACLE = {"op2_warc": warc.ORACLE, "op3_secrets": secrets.oracle(), "op7_mixing": mixing.ORACLE, "op8_substring_dedup": substrings.ORACLE, "op10_exact_dedup": exact.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_merkle_manifest": merkle.oracle()}
