"""Sources and sinks over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.catalog.base import Catalog
from engramlake.sources import readers as R

C = Catalog()


def _files(t):
    return t.raw("training_files").dropDuplicates(["file_id"]).select("path", "body", "file_id")


C.add("source_chunk_markdown", lambda t: R.chunk_markdown(_files(t)).select("path", "chunk_no", "heading", "words"))
C.add("source_code_symbols", lambda t: R.code_symbols(_files(t)).where("kind = 'variable'").groupBy("path").agg(F.count("*").alias("n")),
      r"""WITH b AS (SELECT DISTINCT ON (file_id) file_id, path, replace(body, chr(13) || chr(10), chr(10)) AS body FROM training_files WHERE body IS NOT NULL), m AS (SELECT path, code FROM (SELECT path, unnest(regexp_extract_all(body, '(?ms)^[ \t]*```[^\n`]*\n.*?^[ \t]*```')) AS code FROM b) WHERE regexp_matches(code, '^[ \t]*```(py|python|)[ \t]*\n'))
 SELECT path, sum(len(regexp_extract_all(code, '(?m)^[A-Za-z_]\w* = ')))::BIGINT AS n FROM m GROUP BY 1 HAVING sum(len(regexp_extract_all(code, '(?m)^[A-Za-z_]\w* = '))) > 0""")
C.add("source_html", lambda t: t.documents.where("text IS NOT NULL").select("doc_id", R.html_to_text(F.concat(F.lit("<html><head><title>x</title></head><h1>Note</h1><p>"), F.col("lang"), F.lit("</p></html>"))).alias("text")),
      "SELECT doc_id, concat('# Note', chr(10), chr(10), lang) AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NOT NULL AND lang IS NULL")
C.add("source_catalog_triples", lambda t: R.catalog_triples(_columns(t)))
C.add("sink_markdown", lambda t: R.graph_to_markdown(t.neurons, t.synapses),
      """{n, e} WITH b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC NULLS LAST, target_id) AS r FROM e), l AS (SELECT source_id, string_agg('- ' || type || ' [[' || target_id || ']]', chr(10) ORDER BY r) AS links FROM b WHERE r <= 20 GROUP BY 1)
 SELECT id, concat_ws(chr(10) || chr(10), '# ' || coalesce(content, '(empty)'), links) AS markdown FROM n LEFT JOIN l ON source_id = id""")


def _columns(t):
    names = ("neurons", "synapses", "fibers", "documents", "orders", "lineitem")
    rows = [(n, f.name, f.dataType.simpleString()) for n in names for f in t.raw(n).schema.fields]
    return t.spark.createDataFrame(rows, "table_name string, column_name string, data_type string")
