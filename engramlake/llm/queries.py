"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.cooccurrence import cooccurrence, memory_baskets
from engramlake.llm.encode import encode_corpus
from engramlake.llm.leakage import leaked_passages, reparameterised
from engramlake.llm.near_duplicates import near_duplicate_pairs, near_duplicates
from engramlake.llm.neighbours import neighbour_lists, neighbour_pairs
from engramlake.llm.pii import personal_kinds, tag_personal
from engramlake.llm.sentences import split_sentences
from engramlake.llm.splitting import oversized_sections, split_sections
from engramlake.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(table(spark, sf_dir, "neurons"))


def p1_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_lists(table(spark, sf_dir, "neurons")).select("id", "other", F.round("cos", 4).alias("cos"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "neurons"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every neuron with a long enough content, its class and the class's number of links."""
    members, links = near_duplicates(table(spark, sf_dir, "neurons"))
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    degree = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(degree, "rep", "left").select("neuron_id", "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_sections(table(spark, sf_dir, "training_files"), table(spark, sf_dir, "training_configs"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "training_files"), table(spark, sf_dir, "training_configs"))


def _together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(memory_baskets(table(spark, sf_dir, "co_activations"), table(spark, sf_dir, "fibers")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(spark, sf_dir).select(F.col("item_a").alias("neuron_a"), F.col("item_b").alias("neuron_b"))


def p4_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _together(spark, sf_dir).select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_kinds(table(spark, sf_dir, "neurons"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_personal(table(spark, sf_dir, "neurons")).select("id", "redacted")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reparameterised(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "start_pos")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_lists, p2_found, p2_classes, p3_found, p3_pieces, p4_found, p4_lift, p5_found, p5_redacted, p7_ids, p8_found, p8_reparameterised, p9_found, p9_sentences)
}

_CANON = r"""
canon AS (
  SELECT DISTINCT id, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS body FROM neurons WHERE id IS NOT NULL AND content IS NOT NULL
), long AS (SELECT id, body FROM canon WHERE length(body) >= 60),
sets AS (SELECT body, list_distinct(list_transform(range(1, length(body) - 1), lambda i: substring(body, i, 3))) AS g FROM (SELECT DISTINCT body FROM long)),
near AS (
  SELECT a.body AS x, b.body AS y FROM sets a JOIN sets b ON a.body < b.body AND len(b.g) >= 0.7 * len(a.g) AND len(a.g) >= 0.7 * len(b.g)
  WHERE len(list_intersect(a.g, b.g)) >= 0.7 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))
)"""

_BASKETS = """
items AS (
  SELECT DISTINCT record, item FROM (
    SELECT 'c:' || id AS record, unnest([neuron_a, neuron_b]) AS item FROM co_activations
    UNION ALL SELECT 'f:' || id, unnest(neuron_ids) FROM fibers
  ) WHERE item IS NOT NULL AND record IS NOT NULL
), kept AS (SELECT record, item FROM items WHERE record IN (SELECT record FROM items GROUP BY record HAVING count(*) > 1)),
total AS (SELECT count(DISTINCT record) AS n FROM kept), single AS (SELECT item, count(*) AS n FROM kept GROUP BY item),
pairs AS (SELECT a.item AS a, b.item AS b, count(*) AS n_ab FROM kept a JOIN kept b ON a.record = b.record AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 8),
held AS (
  SELECT a, b, n_ab, x.n AS n_a, y.n AS n_b, n_ab * total.n / (x.n::DOUBLE * y.n) AS lift FROM pairs JOIN single x ON x.item = a JOIN single y ON y.item = b CROSS JOIN total
  WHERE n_ab * total.n >= 10 * x.n * y.n
)"""

_COSINES = """
good AS (
  SELECT id, any_value(embedding)::DOUBLE[] AS e FROM neurons
  WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY id
), ranked AS (
  SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS cos, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r
  FROM good a JOIN good b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.85
)"""

_SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SECTIONS = rf"""
b AS (SELECT DISTINCT ON (file_id) file_id, config_id, body FROM training_files WHERE file_id IS NOT NULL AND body IS NOT NULL),
l AS (SELECT file_id, rtrim(t, chr(13)) AS t, i FROM (SELECT file_id, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b)),
m AS (SELECT file_id, min(i) AS k FROM l WHERE i > 1 AND rtrim(t) = '---' AND file_id IN (SELECT file_id FROM l WHERE i = 1 AND rtrim(t) = '---') GROUP BY 1),
f AS (SELECT l.*, regexp_matches(t, '^\s*```') AS mark, sum(regexp_matches(t, '^\s*```')::INT) OVER (PARTITION BY file_id ORDER BY i) AS fences FROM l LEFT JOIN m USING (file_id) WHERE i > coalesce(k, 0)),
h AS (SELECT *, NOT mark AND fences % 2 = 0 AND regexp_matches(t, '^#{{1,6}} .*[^{_SPACE}]') AS head FROM f),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY file_id ORDER BY i) AS section_no FROM h),
w AS (SELECT file_id, section_no::INT AS section_no, sum(len(regexp_extract_all(t, '[^{_SPACE}]+'))) AS words FROM s WHERE NOT head GROUP BY 1, 2)"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": f"WITH {_SECTIONS} SELECT file_id, section_no FROM w JOIN b USING (file_id) JOIN training_configs USING (config_id) WHERE words > max_chunk_words",
    "p1_found": f"WITH {_COSINES} SELECT DISTINCT least(id, other) AS neuron_a, greatest(id, other) AS neuron_b FROM ranked WHERE r <= 5",
    "p1_lists": f"WITH {_COSINES} SELECT id, other, round(cos, 4) AS cos FROM ranked WHERE r <= 5",
    "p2_found": f"""WITH {_CANON}
SELECT DISTINCT least(p.id, q.id) AS neuron_a, greatest(p.id, q.id) AS neuron_b FROM near JOIN long p ON p.body = near.x JOIN long q ON q.body = near.y WHERE p.id <> q.id
UNION SELECT p.id, q.id FROM long p JOIN long q ON p.body = q.body AND p.id < q.id""",
    "p2_classes": f"""WITH {_CANON}, degree AS (SELECT body, count(*) AS links FROM (SELECT x AS body FROM near UNION ALL SELECT y FROM near) GROUP BY body)
SELECT long.id AS neuron_id, c.class_id, coalesce(degree.links, 0) AS links FROM long
JOIN (SELECT body, min(id) AS class_id FROM long GROUP BY body) c USING (body) LEFT JOIN degree USING (body)""",
    "p4_found": f"WITH {_BASKETS} SELECT a AS neuron_a, b AS neuron_b FROM held",
    "p4_lift": f"WITH {_BASKETS} SELECT a AS item_a, b AS item_b, n_ab, n_a, n_b, round(lift, 6) AS lift FROM held",
    "p8_found": r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, substring(t, p::INT, 50) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS p FROM d WHERE length(t) >= 50)),
ig AS (SELECT item_id, substring(t, p::INT, 50) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS p FROM i WHERE length(t) >= 50))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
