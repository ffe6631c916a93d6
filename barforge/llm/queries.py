"""The queries of this package and, where SQL can express one, the same in SQL."""

from __future__ import annotations

from . import embedding_neardup, mixing, sharding, topk
from .bpe import op8_bpe
from .embedding_neardup import op1_embedding_neardup
from .langid import op6_langid
from .mixing import op5_mixing
from .pii import op7_pii
from .quality import op2_quality
from .sharding import op4_sharding
from .simhash import op3_simhash
from .tokencount import op9_token_counts
from .topk import op10_topk

QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_quality, op3_simhash, op4_sharding, op5_mixing, op6_langid, op7_pii, op8_bpe, op9_token_counts, op10_topk)}
ORACLES = {"op1_embedding_neardup": embedding_neardup.ORACLE_SQL, "op4_sharding": sharding.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL}
