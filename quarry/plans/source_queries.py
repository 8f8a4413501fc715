"""Queries that write whole tables in each format and read them back, and what is known of saved datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical, points, prepare
from ..operators._tables import scratch as _scratch
from ..sources import datasets, exports, readers
from ..streaming import ingest
from .map_queries import _MAP, _assigned, _projection
from .queries import _CHUNKS, _TOKENS, _TRIM, _docs, _table, query


#: Rows of a CSV file: one with quoted line ends can't be split, so that a task reads whole files.
CSV_ROWS = 10_000


@query("src_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv(spark, sf_dir):
    path = _scratch(spark) + ".csv"
    docs = _docs(spark, sf_dir)
    readers.write_csv(docs, path, CSV_ROWS)
    back = readers.load_table(spark, path)
    return back.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in docs.select("doc_id", "text", "lang", "source", "n_chars").schema))


@query("src_jsonl", "SELECT doc_id, text, lang FROM documents")
def src_jsonl(spark, sf_dir):
    path = _scratch(spark) + ".jsonl"
    _docs(spark, sf_dir).write.json(path)
    return readers.load_table(spark, path).select("doc_id", "text", "lang")


@query("src_excel", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, replace(text, chr(13), '') AS text FROM conversations")
def src_excel(spark, sf_dir):
    """Workbooks of the conversations, each with a row of names, and back."""
    books = readers.to_workbooks(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), 2000)
    return readers.from_workbooks(books).select("conv_id", "turn", "role", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))


@query("src_json", "SELECT conv_id, turn, role, text FROM conversations")
def src_json(spark, sf_dir):
    """Files of one array of objects each: the turns are dealt out, and a file holds so many at most."""
    path = _scratch(spark) + ".json"
    rows = _table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    readers.write_json_arrays(rows, path, 10_000)
    return readers.load_table(spark, path).select("conv_id", "turn", "role", "text")


@query("src_txt", "WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents) SELECT line AS text, count(*) AS n FROM l WHERE regexp_matches(line, '\\S') GROUP BY line")
def src_txt(spark, sf_dir):
    path = _scratch(spark) + ".txt"
    _docs(spark, sf_dir).select(F.regexp_replace("text", "\r", "").alias("value")).write.text(path)
    return readers.load_table(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("line_numbers", "WITH l AS (SELECT unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents), n AS (SELECT count(*) AS n FROM l WHERE regexp_matches(line, '\\S')) SELECT n AS n_lines, 1::BIGINT AS first, n AS last, n AS n_numbers FROM n")
def line_numbers(spark, sf_dir):
    """All lines are numbered from 1 without a gap, through the files that tasks wrote."""
    path = _scratch(spark) + ".txt"
    _docs(spark, sf_dir).select(F.regexp_replace("text", "\r", "").alias("value")).write.text(path)
    lines = readers.read_text(spark, path, through=True)
    return lines.agg(F.count("*").alias("n_lines"), F.min("line_number").alias("first"), F.max("line_number").alias("last"), F.count_distinct("line_number").alias("n_numbers"))


@query("src_preview", "SELECT 'doc_id,text,lang,source,n_chars' AS columns, count(*) AS n_rows, 5::BIGINT AS n_shown FROM documents")
def src_preview(spark, sf_dir):
    columns, head, count = readers.preview(_docs(spark, sf_dir))
    return head.agg(F.lit(",".join(columns)).alias("columns"), F.lit(count).cast("long").alias("n_rows"), F.count("*").alias("n_shown"))


@query("dataset_round_trip", "SELECT doc_id, lang, label, round(embedding[1]::DOUBLE, 6) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def dataset_round_trip(spark, sf_dir):
    root = _scratch(spark)
    datasets.save(spark, root, "one", {"documents": _docs(spark, sf_dir), "embeddings": _table(spark, sf_dir, "embeddings")})
    back = datasets.load(spark, root, "one")
    vectors = back["embeddings"].select(F.col("vec_id").alias("doc_id"), "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return back["documents"].join(vectors, "doc_id", "left").select("doc_id", "lang", "label", "first")


@query("dataset_stats", "SELECT 'documents' AS name, count(*) AS n_rows, 0::DOUBLE AS vector_mb FROM documents UNION ALL SELECT 'embeddings', count(*), round(sum(len(embedding)) * 4 / 1048576.0::DOUBLE, 6) FROM embeddings")
def dataset_stats(spark, sf_dir):
    return datasets.stats({"documents": _docs(spark, sf_dir), "embeddings": _table(spark, sf_dir, "embeddings")}).withColumn("vector_mb", F.round("vector_mb", 6))


@query("dataset_catalog", "SELECT * FROM (VALUES ('b', 2::BIGINT), ('a', 2::BIGINT)) t(name, n_tables)")
def dataset_catalog(spark, sf_dir):
    """Two datasets, of which one is saved twice, another is deleted; settings stay apart."""
    root, tables = _scratch(spark), {"documents": _table(spark, sf_dir, "region"), "embeddings": _table(spark, sf_dir, "nation")}
    for name in ("a", "gone", "a", "b"):
        datasets.save(spark, root, name, tables)
    datasets.delete(spark, root, "gone")
    datasets.save_value(spark, root, "settings", "{}")
    return datasets.catalog(spark, root).select("name", F.size("tables").cast("long").alias("n_tables"))


@query("dataset_settings", "SELECT '{\"n_docs\": ' || count(*) || ', \"n_chars\": ' || sum(n_chars) || '}' AS settings, NULL::VARCHAR AS session FROM documents")
def dataset_settings(spark, sf_dir):
    """Settings that say what a table holds, saved twice; a session that is cleared."""
    root, counts = _scratch(spark), _docs(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("n_chars").alias("c")).first()
    for value in ("{}", f'{{"n_docs": {counts["n"]}, "n_chars": {counts["c"]}}}'):
        datasets.save_value(spark, root, "settings", value)
    datasets.save_value(spark, root, "session", "{}")
    datasets.clear_value(spark, root, "session")
    return spark.range(1).select(F.lit(datasets.load_value(spark, root, "settings")).alias("settings"), F.lit(datasets.load_value(spark, root, "session")).cast("string").alias("session"))


@query("index_stats", f"WITH t AS (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), v AS (SELECT count(*) AS n_vectors, round(sum(len(embedding) * 4 + 4) / 1048576.0::DOUBLE, 6) AS memory_mb FROM embeddings) SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings, count(DISTINCT doc_id) AS n_indexed, any_value(n_vectors) AS n_vectors, any_value(memory_mb) AS memory_mb FROM t, v")
def index_stats(spark, sf_dir):
    return datasets.index_stats(lexical.postings(_docs(spark, sf_dir)), _table(spark, sf_dir, "embeddings")).withColumn("memory_mb", F.round("memory_mb", 6))


def _export_tables(spark, sf_dir):
    placed = points.map_points(_docs(spark, sf_dir), _projection(spark, sf_dir), _assigned(spark, sf_dir), ["lang"])
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    chunks = prepare.chunk(_docs(spark, sf_dir)).join(vectors.withColumnRenamed("doc_id", "parent_id"), "parent_id")
    return placed, vectors, chunks


@query("export_v3", f"""WITH {_MAP}, {_CHUNKS}, n AS (SELECT parent_id, count(*) AS n FROM chunks JOIN embeddings ON vec_id = parent_id GROUP BY parent_id)
SELECT doc_id::VARCHAR AS id, text, coalesce(cluster, -1)::INT AS cluster, coalesce(round(x, 9), 0) AS x, lang, round(embedding[64]::DOUBLE, 6) AS last, coalesce(n, 0) AS n_chunks FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN n ON parent_id = doc_id""")
def export_v3(spark, sf_dir):
    path = _scratch(spark)
    exports.export_v3(*_export_tables(spark, sf_dir), path)
    back = exports.import_v3(spark, path)
    counts = back["chunks"].groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    out = back["documents"].join(back["parents"].withColumnRenamed("doc_id", "id"), "id", "left").join(counts, "id", "left")
    return out.select("id", "text", "cluster", F.round("x", 9).alias("x"), F.col("metadata")["lang"].alias("lang"), F.round(F.col("vector")[63].cast("double"), 6).alias("last"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))


@query("export_selection", f"WITH {_MAP} SELECT doc_id::VARCHAR AS id, cluster, round(y, 9) AS y, len(embedding) AS dim FROM m JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE x > 0.2")
def export_selection(spark, sf_dir):
    """A lasso's selection as nested documents of a bounded size, and back."""
    path = _scratch(spark)
    placed, vectors, chunks = _export_tables(spark, sf_dir)
    exports.write_documents(placed.filter("x > 0.2"), vectors, chunks, path)
    back = exports.import_v3(spark, path)
    return back["documents"].join(back["parents"].withColumnRenamed("doc_id", "id"), "id").select("id", "cluster", F.round("y", 9).alias("y"), F.size("vector").cast("long").alias("dim"))


@query("export_vectors", f"WITH {_CHUNKS} SELECT chunk_id, parent_id::VARCHAR AS doc_id, position AS chunk_index FROM chunks JOIN embeddings ON vec_id = parent_id WHERE label = 3")
def export_vectors(spark, sf_dir):
    _, vectors, chunks = _export_tables(spark, sf_dir)
    ids = _table(spark, sf_dir, "embeddings").filter("label = 3").select("vec_id")
    return exports.selected_vectors(ids, vectors, chunks)[1].select("chunk_id", "doc_id", "chunk_index")


@query("doc_key", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 0 THEN 'm' || doc_id ELSE 'row' || doc_id END AS key FROM documents")
def doc_key(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", F.lit(" ").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("docId"), F.create_map(F.lit("id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), "doc_id"))).alias("metadata"))
    keyed = rows.withColumnRenamed("doc_id", "row")
    return keyed.select(F.col("row").alias("doc_id"), exports.doc_key(keyed, F.concat(F.lit("row"), "row")).alias("key"))


@query("vec_serialize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)), 9) AS total, embedding[1]::DOUBLE AS first FROM embeddings")
def vec_serialize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", exports.encode_vector(F.col("embedding")).alias("packed"))
    back = rows.select("vec_id", F.explode(F.array(exports.decode_vector(F.col("packed")))).alias("v"))
    return back.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.col("v")[0].alias("first"))


@query("emb_normalise", "SELECT vec_id AS doc_id, round(embedding[1]::DOUBLE, 6) AS retrieval, round(embedding[1]::DOUBLE, 6) AS clustering, 'single-embedding-legacy' AS schema FROM embeddings")
def emb_normalise(spark, sf_dir):
    old = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    first = lambda c: F.round(F.col(c)[0].cast("double"), 6).alias(c)
    return exports.normalized_embeddings(old).select("doc_id", first("retrieval"), first("clustering"), "schema")


@query("older_exports", "SELECT doc_id::VARCHAR AS id, length(text)::BIGINT AS n, round(embedding[1]::DOUBLE, 6) AS first FROM documents JOIN embeddings ON vec_id = doc_id")
def older_exports(spark, sf_dir):
    """Files of the 1.0 shape, of a bounded number of documents each, read back."""
    path = _scratch(spark)
    rows = _docs(spark, sf_dir).join(_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    exports.write_older(rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("embedding").alias("vector")), path, 500)
    back = exports.read_older(spark, path)
    return back["documents"].join(back["embeddings"].withColumnRenamed("doc_id", "id"), "id").select("id", F.length("text").cast("long").alias("n"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("get_document", "SELECT doc_id, lang, text FROM documents WHERE doc_id = 42")
def get_document(spark, sf_dir):
    return _docs(spark, sf_dir).filter("doc_id = 42").select("doc_id", "lang", "text")


@query("all_ids", "SELECT DISTINCT doc_id FROM documents")
def all_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id").distinct()


@query("conversation_csv", "WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations) SELECT conv_id || '-' || turn AS timestamp, 2::INT AS num_sources, 'doc_' || conv_id || '|doc_' || turn AS source_ids, count(*) AS n FROM q WHERE answer IS NOT NULL GROUP BY ALL")
def conversation_csv(spark, sf_dir):
    from pyspark.sql import Window

    turns = _table(spark, sf_dir, "conversations")
    answered = turns.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("answer is not null")
    log = answered.select(F.concat_ws("-", "conv_id", "turn").alias("timestamp"), F.col("text").alias("query"), "answer", F.array(F.concat(F.lit("doc_"), "conv_id"), F.concat(F.lit("doc_"), "turn")).alias("sources"), F.lit("none").alias("model"), F.lit(0.5).alias("temperature"))
    path = _scratch(spark) + ".csv"
    datasets.write_conversation(log, path)
    back = readers.load_table(spark, path)
    return back.groupBy(F.col("timestamp").cast("string").alias("timestamp"), F.col("num_sources").cast("int").alias("num_sources"), "source_ids").agg(F.count("*").alias("n"))


@query("stream_windows", """WITH b AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT start, event_type, n_events, total FROM w, b WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_windows(spark, sf_dir):
    events = ingest.files(spark, sf_dir, _table(spark, sf_dir, "events").schema, "events.parquet")
    path = _scratch(spark)
    ingest.drain(ingest.windowed_counts(events, "1 hour", "1 hour"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 4)})


_ONE = f"SELECT min(doc_id) AS doc_id, min_by(lang, doc_id) AS lang, count(*) > 1 AS repeated, any_value(text) AS text FROM documents GROUP BY {_TRIM.format('text')}"


#: Batches of a stream of all documents, and the bytes of texts in one of its files, on the average.
BATCHES, FILE_BYTES = 3, 64 << 20


def _streamed(spark, sf_dir, file_bytes: int = FILE_BYTES):
    """The index after documents came as a stream, in several batches, in no order; a batch has as many files as its texts need."""
    docs, path = _docs(spark, sf_dir), _scratch(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_once = -(-size // (BATCHES * file_bytes)) or 1
    docs.repartition(BATCHES * at_once).write.parquet(f"{path}/arriving")
    ingest.ingest_documents(ingest.files(spark, f"{path}/arriving", docs.schema, "*.parquet", at_once=at_once), path, f"{path}/checkpoint")
    return path


@query("stream_documents", f"SELECT doc_id, lang, repeated FROM ({_ONE})")
def stream_documents(spark, sf_dir):
    """Documents that arrive as a stream: the smallest id of each text is kept."""
    return ingest.documents(spark, _streamed(spark, sf_dir)).select("doc_id", "lang", (F.col("n_copies") > 1).alias("repeated"))


@query("stream_postings", f"WITH d AS ({_ONE}) SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM d) GROUP BY ALL")
def stream_postings(spark, sf_dir):
    return ingest.postings(spark, _streamed(spark, sf_dir))


@query("stream_statistics", f"WITH d AS ({_ONE}) SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, round(greatest(1.0, avg(n)), 6) AS avg_tokens FROM (SELECT len({_TOKENS.format('text')}) AS n FROM d)")
def stream_statistics(spark, sf_dir):
    return ingest.statistics(spark, _streamed(spark, sf_dir)).withColumn("avg_tokens", F.round("avg_tokens", 6))
