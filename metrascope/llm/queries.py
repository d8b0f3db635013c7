"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op2_multi_index_hashing
from .bpe import op9_byte_bpe
from .chat_format import OP5_SQL, op5_chat_format
from .decontamination import OP12_SQL, op12_benchmark_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .importance import OP13_SQL, op13_importance_resampling
from .jaccard_join import op6_jaccard_join
from .packing import op7_best_fit_packing
from .quality import op1_quality
from .toxicity import op10_toxicity
from .url_filter import OP4_SQL, op4_url_filter
from .warc import OP8_SQL, op8_warc

#: All pairs that share a shingle, then what each document reaches; for small tables.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS d, y AS o FROM e UNION SELECT r.d, e.y FROM r JOIN e ON e.x = r.o),
c AS (SELECT d, min(o) AS o FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(c.o, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = doc_id
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_multi_index_hashing": op2_multi_index_hashing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_chat_format": op5_chat_format,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_warc": op8_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op4_url_filter": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op12_benchmark_decontamination": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
