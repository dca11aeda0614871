"""The training-data queries and their SQL, for the entry point."""

from __future__ import annotations

from . import op1_jaccard_join as op1
from . import op2_toxicity as op2
from . import op3_quality_gam as op3
from . import op4_chat_format as op4
from . import op5_token_orc as op5
from . import op6_suffix_dedup as op6
from . import op7_url_filter as op7
from . import op8_decontaminate as op8
from . import op9_quality_rules as op9
from . import op10_bpe as op10
from . import op11_spelling_variants as op11
from . import op12_debruijn_dedup as op12
from . import op13_merkle_manifest as op13
from .runtime import prepare


def _with_session(f):
    def query(spark, sf_dir):
        prepare(spark)
        return f(spark, sf_dir)

    query.__name__ = f.__name__
    query.__doc__ = f.__doc__
    return query


_ALL = [op1.op1_jaccard_join, op2.op2_toxicity, op3.op3_quality_gam, op4.op4_chat_format, op5.op5_token_orc, op6.op6_suffix_dedup, op7.op7_url_filter, op8.op8_decontaminate, op9.op9_quality_rules, op10.op10_bpe, op11.op11_spelling_variants, op12.op12_debruijn_dedup, op13.op13_merkle_manifest]

QUERIES = {f.__name__: _with_session(f) for f in _ALL}
ORACLE_SQL = {"op4_chat_format": op4.oracle(), "op9_quality_rules": op9.oracle(), "op11_spelling_variants": op11.oracle(), "op12_debruijn_dedup": op12.oracle(), "op13_merkle_manifest": op13.oracle()}
