"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from .ann_tree import op1_ann_tree
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .jaccard_join import OP10_SQL, op10_ngram_jaccard
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import op2_mixing
from .packing import op9_packing
from .secret_scan import op4_secret_scan
from .sharding import op7_sharding
from .toxicity import op5_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_ann_tree": op1_ann_tree,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op6_line_dedup": OP6_SQL, "op8_warc": OP8_SQL, "op10_ngram_jaccard": OP10_SQL}
