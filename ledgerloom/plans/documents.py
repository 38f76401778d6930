"""Queries over documents, pages and vectors: cleaning, clauses, search, incremental packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunks, clauses, documents, packs, retrieval
from ..sources.tables import table
from .catalog import query

SEARCH = "the tion and"
#: Keyword classes that the fixture's invented words can meet; lang stands for the tax.
CLASSES = {"definition": ["tion", "ción"], "procedure": ["ing ", "ment"], "exemption": ["ble", "keit"], "transfer": ["ist ", "que "]}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_COUNT = lambda w: f"((length(text) - length(replace(text, '{w}', ''))) // {len(w)})"
_SCORE = " + ".join(_COUNT(w) for w in SEARCH.split())
_AT = "least(" + ", ".join(f"coalesce(nullif(strpos(text, '{w}'), 0), 2000000000)" for w in SEARCH.split()) + ")"
_SNIP = f"trim(regexp_replace(substring(text, greatest({_AT} - 201, 0) + 1, {_AT} - 1 + 600 - greatest({_AT} - 201, 0)), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score, {_SNIP} AS snippet FROM documents WHERE {_SCORE} >= 2 ORDER BY score DESC, doc_id LIMIT 5")
def keyword_search(spark, sf_dir):
    return retrieval.keyword_search(_docs(spark, sf_dir), SEARCH, top=5)


@query(f"""WITH h AS (SELECT doc_id, {_SCORE} AS score, {_SNIP} AS snippet FROM documents WHERE {_SCORE} >= 2 ORDER BY score DESC, doc_id LIMIT 3)
  SELECT '【知识库参考】（仅作参考、以官方现行规定为准；引用请标注来源）' || chr(10) || string_agg('- 来源：' || CAST(doc_id AS VARCHAR) || chr(10) || '  ' || snippet, chr(10) ORDER BY score DESC, doc_id) AS context FROM h""")
def context_block(spark, sf_dir):
    return retrieval.context_block(retrieval.keyword_search(_docs(spark, sf_dir), SEARCH))


_TERMS = "[t FOR t IN regexp_extract_all(text, '[一-龥]{2,}|[A-Za-z0-9]{2,}') IF t NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP) + ")]"


@query(f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL HAVING count(*) >= 20")
def term_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("lang", F.explode(tx.terms_col("text")).alias("term"))
    return rows.groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 20")


def _nested(expr: str) -> str:
    """All redactions for DuckDB, which has no look-around.

    A border is matched and put back; as two findings may share one, such a rule is applied twice.
    """
    border = "[^0-9A-Za-z_一-龥]"
    for pattern, by in tx.REDACTIONS:
        by = by.replace("$", chr(92))
        if pattern.startswith(tx._B):
            core = pattern.removeprefix(tx._B).removesuffix(tx._E).replace("(?:[0-9][ -]?){15,19}(?<=[0-9])", "[0-9](?:[ -]?[0-9]){14,18}")
            for _ in range(2):
                expr = f"regexp_replace({expr}, '(^|{border}){core}({border}|$)', '\\1{by}\\2', 'g')"
        else:
            expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


@query(f"SELECT doc_id, {_nested('text')} AS text FROM documents")
def redact_pii(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.redact("text").alias("text"))


@query(f"SELECT conv_id, turn, {_nested('text')} AS text FROM conversations")
def redact_pii_all(spark, sf_dir):
    """All rules over what people wrote to each other."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.redact("text").alias("text"))


@query()
def clean_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", documents.clean("text").alias("text"))


@query()
def doubled_word_collapse(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.collapse_doubled("text").alias("text"))


@query("""WITH l AS (SELECT doc_id, trim(x, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents))
  SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' AND length(line) <= 80 GROUP BY doc_id, line HAVING count(*) >= 5""")
def repeated_line_drop(spark, sf_dir):
    return documents.repeated_lines(_docs(spark, sf_dir))


@query("""WITH f AS (SELECT doc_id, length(text) AS n, substring(sha256(substring(regexp_replace(text, '[\\s　]+', '', 'g'), 1, 4000)), 1, 12) AS fingerprint FROM documents)
  SELECT fingerprint, arg_max(doc_id, (n, doc_id)) AS kept, count(*) AS copies FROM f GROUP BY fingerprint""")
def fingerprint_dedupe(spark, sf_dir):
    return documents.fingerprint_dedupe(_docs(spark, sf_dir))


@query("SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_text(spark, sf_dir):
    return documents.keep_first(_docs(spark, sf_dir).select("lang", "text", "source", "doc_id"), ["lang", "text"], ["source", "doc_id"]).select("doc_id", "text", "lang")


_LINES = "SELECT doc_id, lang, source, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"


@query(f"""WITH l AS ({_LINES}), k AS (SELECT *, substring(regexp_replace(line, '[\\s　]+', '', 'g'), 1, 120) AS key FROM l WHERE line <> '')
  SELECT lang AS bucket, arg_min(doc_id, (doc_id, line_no)) AS doc_id, arg_min(line, (doc_id, line_no)) AS line FROM k GROUP BY lang, key""")
def clause_dedupe(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("line <> ''")
    keyed = rows.select(F.col("lang").alias("bucket"), F.substring(tx.squeeze("line"), 1, 120).alias("key"), "doc_id", "line_no", "line")
    return documents.keep_first(keyed, ["bucket", "key"], ["doc_id", "line_no"]).select("bucket", "doc_id", "line")


_LEAK_SQL = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, list_distinct(regexp_extract_all(text, '{p}')) AS v FROM documents" for kind, p in documents.LEAKS.items())


@query(f"SELECT doc_id, kind, CAST(len(v) AS INT) AS n FROM ({_LEAK_SQL}) WHERE len(v) > 0")
def leak_audit(spark, sf_dir):
    return documents.leaks(_docs(spark, sf_dir)).drop("examples")


#: The tables state no shares, so each document gets two and a date.
_SHARES = "text || ' 持股' || CAST(doc_id % 130 AS VARCHAR) || '.' || CAST(doc_id % 10 AS VARCHAR) || ' %、' || CAST(doc_id % 1100 AS VARCHAR) || '%，20' || CAST(10 + doc_id % 15 AS VARCHAR) || '年3月 5日'"


@query(f"""WITH d AS (SELECT doc_id, {_SHARES} AS text FROM documents),
  p AS (SELECT doc_id, regexp_split_to_array(text, '[0-9]{{1,3}}(?:\\.[0-9]+)?\\s*%') AS gaps, regexp_extract_all(text, '([0-9]{{1,3}}(?:\\.[0-9]+)?)\\s*%', 1) AS shares FROM d),
  t AS (SELECT doc_id, array_to_string([g || CASE WHEN i > len(shares) THEN '' WHEN CAST(shares[i] AS DOUBLE) >= 99.5 THEN '[全资]' WHEN CAST(shares[i] AS DOUBLE) >= 50 THEN '[控股]' ELSE '[参股]' END FOR g, i IN gaps], '') AS text FROM p)
  SELECT doc_id, regexp_replace(text, '(20[0-9]{{2}})\\s*年\\s*[0-9]{{1,2}}\\s*月(?:\\s*[0-9]{{1,2}}\\s*日)?', '\\1年', 'g') AS text FROM t""")
def generalize_ratio(spark, sf_dir):
    d, text = F.col("doc_id"), lambda c: c.cast("string")
    shares = F.concat("text", F.lit(" 持股"), text(d % 130), F.lit("."), text(d % 10), F.lit(" %、"), text(d % 1100), F.lit("%，20"), text(10 + d % 15), F.lit("年3月 5日"))
    return _docs(spark, sf_dir).select("doc_id", tx.generalize(shares).alias("text"))


_CLASS = ", ".join("CASE WHEN " + " OR ".join(f"contains(line, '{w}')" for w in ws) + f" THEN '{c}' END" for c, ws in CLASSES.items())
_LABELLED = f"l AS ({_LINES}), c AS (SELECT *, [x FOR x IN [{_CLASS}] IF x IS NOT NULL] AS labels FROM l WHERE line <> '')"


def _clauses(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where("line <> ''").withColumn("labels", clauses.labels("line", CLASSES))


@query(f"WITH {_LABELLED} SELECT lang AS tax, label AS rule, count(*) AS n_clauses, count(DISTINCT doc_id) AS n_docs FROM (SELECT lang, doc_id, unnest(labels) AS label FROM c) GROUP BY ALL")
def multilabel_buckets(spark, sf_dir):
    rows = clauses.buckets(_clauses(spark, sf_dir).withColumn("taxes", F.array("lang")).withColumn("rules", F.col("labels")))
    return rows.groupBy("tax", "rule").agg(F.count("*").alias("n_clauses"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"""WITH {_LABELLED}, t AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id), k AS (SELECT doc_id, label, count(*) AS k FROM (SELECT doc_id, unnest(labels) AS label FROM c) GROUP BY ALL),
  m AS (SELECT doc_id, list_sort(list(label)) AS common FROM k JOIN t USING (doc_id) WHERE k >= 0.3 * n GROUP BY doc_id)
  SELECT doc_id, CAST(line_no AS INT) AS line_no, array_to_string(CASE WHEN len(labels) = 0 AND common IS NOT NULL THEN common ELSE labels END, ',') AS labels,
    len(labels) = 0 AND common IS NOT NULL AS inherited FROM c LEFT JOIN m USING (doc_id)""")
def tax_spillover(spark, sf_dir):
    rows = clauses.spill_over(_clauses(spark, sf_dir).select("doc_id", "line_no", "labels"))
    return rows.select("doc_id", "line_no", F.array_join("labels", ",").alias("labels"), "inherited")


@query(f"""WITH {_LABELLED} SELECT lang AS tax, label AS rule, count(*) AS n_clauses, count(DISTINCT doc_id) AS n_docs, CAST(grouping(lang) AS TINYINT) AS all_tax, CAST(grouping(label) AS TINYINT) AS all_rule
  FROM (SELECT lang, doc_id, unnest(labels) AS label FROM c) GROUP BY ROLLUP (lang, label)""")
def bucket_summary_rollup(spark, sf_dir):
    rows = clauses.buckets(_clauses(spark, sf_dir).withColumn("taxes", F.array("lang")).withColumn("rules", F.col("labels")))
    return clauses.bucket_summary(rows, ["tax", "rule"])


@query("SELECT doc_id, lang, coalesce(CAST(quality AS VARCHAR), source) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def label_overlay(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.col("source").alias("quality"))
    given = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return clauses.overlay(docs, given, "doc_id", ["quality"])


_EVEN = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(' ' || {_EVEN('d.text')} || ' ', ' ' || {_EVEN('b.text')} || ' ') WHERE {_EVEN('b.text')} <> ''")
def title_substring_join(spark, sf_dir):
    return documents.contained(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""WITH a AS (SELECT source, lang, length(text) // 100 AS size FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT source, lang, length(text) // 100 AS size FROM documents WHERE doc_id % 4 <> 0)
  SELECT source, lang, size, CASE WHEN sum(x) > 0 THEN 'insert' ELSE 'remove' END AS change, CAST(abs(sum(x)) AS BIGINT) AS n FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY source, lang, size HAVING sum(x) <> 0""")
def bucket_multiset_diff(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", "lang", F.expr("length(text) DIV 100").alias("size"))
    return packs.multiset_diff(rows.where("doc_id % 3 <> 0").drop("doc_id"), rows.where("doc_id % 4 <> 0").drop("doc_id"))


_SHARDS = lambda where: f"SELECT source AS shard, sha256(string_agg(sha256(CAST(doc_id AS VARCHAR) || chr(31) || text), '' ORDER BY doc_id)) AS hash FROM documents {where} GROUP BY source"


@query(f"""WITH n AS ({_SHARDS('')}), b AS ({_SHARDS('WHERE doc_id % 50 <> 7')}) SELECT coalesce(n.shard, b.shard) AS shard,
  CASE WHEN b.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN n.hash <> b.hash THEN 'changed' ELSE 'same' END AS change FROM n FULL JOIN b ON n.shard = b.shard""")
def shard_diff(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return packs.shard_diff(packs.shard_manifest(docs), packs.shard_manifest(docs.where("doc_id % 50 <> 7")))


@query("SELECT DISTINCT text AS snippet FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 7 <> 0)")
def cache_miss_anti(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("snippet"))
    return packs.cache_misses(rows, rows.where("doc_id % 7 <> 0"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, [x FOR x IN [trim(y) FOR y IN regexp_split_to_array(text, '\\n\\s*\\n')] IF x <> ''] AS parts FROM documents),
  w AS (SELECT doc_id, parts, 0 AS i, '' AS held, []::VARCHAR[] AS done FROM p UNION ALL
    SELECT doc_id, parts, i + 1, CASE WHEN length(part) > 900 THEN held WHEN length(held) + length(part) >= 600 THEN part WHEN held = '' THEN part ELSE held || chr(10) || part END,
      CASE WHEN length(part) > 900 THEN list_concat(done, [substring(part, CAST(k * 800 + 1 AS BIGINT), 800) FOR k IN range((length(part) - 1) // 800 + 1)])
        WHEN length(held) + length(part) < 600 OR held = '' THEN done ELSE list_append(done, held) END
    FROM (SELECT *, parts[i + 1] AS part FROM w) WHERE i < len(parts)),
  c AS (SELECT doc_id, CASE WHEN held = '' THEN done ELSE list_append(done, held) END AS c FROM w WHERE i = len(parts))
  SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INT) AS chunk_no, unnest(c) AS chunk FROM c""")
def chunk_pack(spark, sf_dir):
    return chunks.chunk(_docs(spark, sf_dir))


def _vector(spark, sf_dir):
    """The first row's vector is the query; one row comes to the driver."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()
    return list(row["embedding"])


_SIM = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4)"


@query(f"SELECT e.vec_id, {_SIM} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return retrieval.vector_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir))


@query(f"SELECT e.vec_id, {_SIM} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label % 2 = 0 ORDER BY score DESC, e.vec_id LIMIT 20")
def cosine_by_lang(spark, sf_dir):
    lang = F.when(F.col("label") % 2 == 0, "en").otherwise("zh")
    return retrieval.routed_search(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), lang, english_query=True, has_reranker=False)


_BM25 = " + ".join(
    f"ln(1 + (f.n - f.df{k} + 0.5) / (f.df{k} + 0.5)) * t.tf{k} * 2.2 / (t.tf{k} + 1.2 * (0.25 + 0.75 * t.len / f.mean))" for k in range(len(SEARCH.split()))
)


@query(f"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
  t AS (SELECT doc_id, len(w) AS len, {", ".join(f"CAST(len([x FOR x IN w IF x = '{x.lower()}']) AS DOUBLE) AS tf{k}" for k, x in enumerate(SEARCH.split()))} FROM w),
  f AS (SELECT count(*) AS n, avg(len) AS mean, {", ".join(f"CAST(count(*) FILTER (WHERE tf{k} > 0) AS DOUBLE) AS df{k}" for k in range(len(SEARCH.split())))} FROM t),
  r AS (SELECT e.vec_id AS doc_id, {_SIM} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY similarity DESC, e.vec_id LIMIT 20)
  SELECT doc_id, similarity, round({_BM25}, 6) AS rank_score FROM r JOIN t USING (doc_id), f ORDER BY rank_score DESC, similarity DESC, doc_id LIMIT 3""")
def two_stage_rank(spark, sf_dir):
    return retrieval.two_stage(table(spark, sf_dir, "embeddings"), _docs(spark, sf_dir), _vector(spark, sf_dir), SEARCH.split())


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
  l AS (SELECT page_id, generate_subscripts(ls, 1) AS line_no, trim(regexp_replace(unnest(ls), '\\s+', ' ', 'g')) AS line FROM (SELECT page_id, string_split(t, chr(10)) AS ls FROM p)),
  f AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) >= 0.02 * (SELECT count(*) FROM pages))
  SELECT page_id, count(k.line) AS n_lines, coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no), '') AS text
  FROM pages LEFT JOIN (SELECT * FROM l WHERE line <> '' AND line NOT IN (SELECT line FROM f)) k USING (page_id) GROUP BY page_id""")
def html_frame_strip(spark, sf_dir):
    return documents.strip_frames(table(spark, sf_dir, "pages"))


@query(f"""WITH l AS ({_LINES}), n AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n)
  SELECT doc_id, CAST(min(line_no) AS INT) AS start, count(*) AS n, min(line) AS line FROM r GROUP BY doc_id, run HAVING count(*) >= 2""")
def line_runs(spark, sf_dir):
    return documents.line_runs(_docs(spark, sf_dir), least=2)


@query("SELECT doc_id, CASE WHEN r = 1 THEN base ELSE base || '-' || CAST(r AS VARCHAR) END AS name FROM (SELECT doc_id, concat(source, '-', lang) AS base, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)")
def unique_names(spark, sf_dir):
    return documents.unique_names(_docs(spark, sf_dir), F.concat_ws("-", "source", "lang"))


@query("""WITH r AS (SELECT source AS project_id, doc_id AS log_seq, text, 60000 - coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM documents)
  SELECT project_id, log_seq, substring(text, 1, CAST(room AS INT)) AS text FROM r WHERE room > 0""")
def project_materials(spark, sf_dir):
    from ..operators import folds

    return folds.project_materials(_docs(spark, sf_dir).select(F.col("source").alias("project_id"), F.col("doc_id").alias("log_seq"), "text"))


_ORDINARY = tx.ORDINARY.replace("'", "''")


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || 'ඈ' WHEN 1 THEN repeat('ü', length(text) * 2) || text ELSE text END AS text FROM documents),
  t AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM d)
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) > 0 AS is_english, length(x) > 0 AND (contains(x, 'ඈ') OR len(regexp_extract_all(x, '{_ORDINARY}')) < 0.6 * length(x)) AS garbled FROM t""")
def text_checks(spark, sf_dir):
    """A quarter of the texts gets a foreign character, another many that are not ordinary."""
    d = F.col("doc_id")
    text = F.when(d % 4 == 0, F.concat("text", F.lit("ඈ"))).when(d % 4 == 1, F.concat(F.repeat(F.lit("ü"), F.length("text") * 2), "text")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", tx.is_english("t").alias("is_english"), tx.garbled("t").alias("garbled"))


@query("""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '\\b(?:the|of)\\b')) AS x, lang, source FROM documents)
  SELECT lang, source, count(*) AS n, CAST(sum(x) AS BIGINT) AS words FROM n GROUP BY ROLLUP (lang, source)""")
def corpus_rollup(spark, sf_dir):
    words = F.regexp_count("text", F.lit(r"\b(?:the|of)\b"))
    return _docs(spark, sf_dir).select("lang", "source", words.alias("x")).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("x").alias("words"))


def _repeal_docs(spark, sf_dir):
    """Benchmark items read as regulations, each repealing the next by title; numbers stand for theirs."""
    k = F.col("item_id")
    name = lambda i: F.concat(F.lit("关于第"), i.cast("string"), F.lit("项事务的办法"))
    issued = lambda i: F.concat(F.lit("税务总局公告2020年第"), i.cast("string"), F.lit("号"))
    cited = F.when(k % 3 == 0, F.concat(F.lit("（"), issued(k + 1), F.lit("）"))).otherwise("")
    text = F.concat(F.lit("本办法自发布之日起施行。《"), name(k + 1), F.lit("》"), cited, F.lit("同时废止。"))
    return table(spark, sf_dir, "benchmark").select(name(k).alias("doc"), text.alias("text"), clauses.document_numbers(issued(k)).alias("nums"))


@query("""WITH k AS (SELECT item_id AS k FROM benchmark), n AS (SELECT k, '关于第' || CAST(k AS VARCHAR) || '项事务的办法' AS doc, '关于第' || CAST(k + 1 AS VARCHAR) || '项事务的办法' AS title FROM k)
  SELECT n.doc, n.title, t.doc AS target, CASE WHEN t.doc IS NULL THEN NULL WHEN n.k % 3 = 0 THEN 'number' ELSE 'title' END AS why FROM n LEFT JOIN n t ON n.title = t.doc""")
def repeal_cascade(spark, sf_dir):
    docs = _repeal_docs(spark, sf_dir)
    return clauses.resolve_repeals(clauses.repeals(docs), docs.select("doc", "nums"))


@query("""WITH k AS (SELECT item_id AS k FROM benchmark) SELECT '关于第' || CAST(k AS VARCHAR) || '项事务的办法' AS doc FROM k WHERE k - 1 NOT IN (SELECT k FROM k)""")
def repealed_anti(spark, sf_dir):
    docs = _repeal_docs(spark, sf_dir)
    gone = clauses.resolve_repeals(clauses.repeals(docs), docs.select("doc", "nums")).where("target IS NOT NULL").select("target").distinct()
    return clauses.without_repealed(docs.select("doc"), gone)
