"""Readers that bring files and exports into tables, and sinks for graphs.

Files are read by Spark's own sources; parsing stays in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names of other memory stores' exports. Fixed values.
EXPORTS = {
    "notes": {"id": "id", "text": "text", "created_at": "created_at"},
    "memories": {"id": "id", "text": "memory", "created_at": "created_at"},
    "collection": {"id": "id", "text": "document", "created_at": "metadata.created_at"},
    "nodes": {"id": "uuid", "text": "content", "created_at": "created_at"},
    "index": {"id": "node_id", "text": "text", "created_at": "metadata.creation_date"},
}


def read_text_files(spark: SparkSession, path: str, *, glob: str = "*.{md,mdx,txt,rst}") -> DataFrame:
    """``(path, body)``: one row a file, whole."""
    return spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_table_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV or JSON-lines file as ``(row, body)`` with each row as ``name: value`` lines."""
    rows = spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.json(path)
    fields = [F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in rows.columns]
    return rows.select(F.concat_ws("\n", *fields).alias("body"))


def html_to_text(html):
    """Text of an HTML page: headings as Markdown, scripts and tags dropped, common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?i)<li\b[^>]*>", "\n- ")
    out = F.regexp_replace(out, r"(?i)<(p|br|div|tr|table|ul|ol)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n\s*", "\n\n"), r"^\s+|\s+$", "")


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(id, text, created_at)`` of a JSON-lines export of another store; see ``EXPORTS``."""
    names = EXPORTS[kind]
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    get = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return raw.select(get(names["id"]).alias("id"), get(names["text"]).alias("text"), F.try_to_timestamp(get(names["created_at"])).cast("timestamp_ntz").alias("created_at")).where("text IS NOT NULL")


def chunk_markdown(files: DataFrame, *, least_words: int = 20, most_words: int = 500) -> DataFrame:
    """``(path, chunk_no, heading, body, words)``: sections of at least ``least_words`` words, cut at blank lines.

    A paragraph longer than ``most_words`` stays whole.
    """
    blocks = F.split(F.regexp_replace("body", r"\r\n?", "\n"), r"\n(?=#{1,6} )")
    rows = files.select("path", F.posexplode(blocks).alias("section", "block"))
    heading = F.regexp_extract("block", r"^#{1,6} ([^\n]*)", 1)
    text = F.trim(F.regexp_replace("block", r"^#{1,6} [^\n]*\n?", ""))
    paras = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    count = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    empty = F.array().cast("array<struct<t:string,n:int>>")
    fold = F.aggregate(
        "paras", empty,
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["n"] + count(p) <= most_words),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat_ws("\n\n", F.element_at(acc, -1)["t"], p).alias("t"), (F.element_at(acc, -1)["n"] + count(p)).alias("n")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.alias("t"), count(p).alias("n"))))),
    )
    cut = rows.select("path", "section", heading.alias("heading"), text.alias("text")).withColumn("paras", paras).select("path", "section", "heading", F.posexplode(fold).alias("part", "c"))
    return cut.where(F.col("c.n") >= least_words).select("path", F.concat_ws(".", "section", "part").alias("chunk_no"), "heading", F.col("c.t").alias("body"), F.col("c.n").alias("words"))


def _python_symbols(source: str) -> list[tuple[str, str, str | None, int]] | None:
    """``(kind, name, parent, line)`` by the syntax tree, or None if the text is no Python."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[tuple[str, str, str | None, int]] = []

    def walk(body: list, parent: str | None) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(("method" if parent else "function", node.name, parent, node.lineno))
            elif isinstance(node, ast.ClassDef):
                out.append(("class", node.name, parent, node.lineno))
                walk(node.body, node.name)
            elif isinstance(node, ast.Import):
                out.extend(("import", a.name, parent, node.lineno) for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                out.extend(("import", f"{node.module or '.'}.{a.name}", parent, node.lineno) for a in node.names)
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        out.append(("constant" if target.id.isupper() and len(target.id) > 1 else "variable", target.id, parent, node.lineno))

    walk(tree.body, None)
    return out


def code_symbols(files: DataFrame) -> DataFrame:
    """``(path, kind, name, parent, line)`` of the symbols of source texts, and of the code blocks of Markdown ones.

    Python by its syntax tree, other languages by the words that declare classes and
    functions.  Lines count within a block.  Null texts and what does not parse have none.
    """
    import re

    import pyarrow as pa

    fence = re.compile(r"(?ms)^[ \t]*```([^\n`]*)\n(.*?)^[ \t]*```")
    declared = re.compile(r"(?m)^[ \t]*(?:(?:export|public|private|protected|static|abstract|pub|async)\s+)*(class|struct|interface|trait|enum|def|func|function|fn)\s+([A-Za-z_]\w*)")

    def symbols(body: str, python: bool) -> list:
        found = _python_symbols(body) if python else None
        if found is None:
            found = [("class" if m[1] in ("class", "struct", "interface", "trait", "enum") else "function", m[2], None, body.count("\n", 0, m.start()) + 1) for m in declared.finditer(body)]
        return found

    def run(batches):
        for batch in batches:
            rows = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = body.replace("\r\n", "\n")
                if path and path.endswith((".md", ".mdx", ".rst", ".txt")) or "```" in body:
                    blocks = [(m[2], m[1].strip().lower() in ("py", "python", "")) for m in fence.finditer(body)]
                else:
                    blocks = [(body, bool(path) and path.endswith((".py", ".pyi")))]
                rows += [(path, *s) for text, python in blocks for s in symbols(text, python)]
            columns = list(zip(*rows)) if rows else [[], [], [], [], []]
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "kind", "name", "parent", "line"])

    return files.where("body IS NOT NULL").select("path", "body").mapInArrow(run, "path string, kind string, name string, parent string, line int")


def catalog_triples(columns: DataFrame) -> DataFrame:
    """``(subject, relation, object)`` knowledge of a schema from ``(table_name, column_name, data_type)``.

    A column named after another table with a key suffix references it.
    """
    has = columns.select(F.col("table_name").alias("subject"), F.lit("has_column").alias("relation"), F.col("column_name").alias("object"))
    stem = F.regexp_replace("column_name", r"(?i)(_?id|_?key)$", "")
    tables = columns.select(F.col("table_name").alias("object")).distinct()
    refs = columns.where(stem != F.col("column_name")).select("table_name", stem.alias("stem")).join(tables, F.lower("object").isin(F.lower("stem"), F.concat(F.lower("stem"), F.lit("s")))).where("table_name <> object")
    return has.unionByName(refs.select(F.col("table_name").alias("subject"), F.lit("references").alias("relation"), "object").distinct())


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """Write a snapshot directory of one table; readers switch by version number."""
    path = f"{root}/v={version:06d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version:06d}")


def graph_to_markdown(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """``(id, markdown)``: each neuron with its 20 strongest outgoing edges as links."""
    from engramlake.operators.scans import top

    best = top(synapses.select("source_id", "target_id", "type", "weight"), ["source_id"], [F.desc("weight"), "target_id"], 20)
    links = best.groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "target_id"))), lambda x: F.concat(F.lit("- "), x["type"], F.lit(" [["), x["target_id"], F.lit("]]"))), "\n").alias("links"))
    return neurons.join(links, F.col("id") == F.col("source_id"), "left").select("id", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("content", F.lit("(empty)"))), "links").alias("markdown"))
