"""The registry of the engine's own queries over the driver's tables, and their oracles for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.functions import work
from loomdex.operators import chats, citations, evaluation, graph, inverted, lexical, lifecycle, retrieval
from loomdex.plans import planner
from loomdex.plans.search import Settings, search
from loomdex.sources import html, markdown, tables
from loomdex.sources.tables import table
from loomdex.streaming import debounce, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@cache
def _fold() -> str:
    a, b = X.fold_table()
    return f"regexp_extract_all(translate(lower(regexp_replace(%s, '[̀-ͯ]', '', 'g')), '{a}', '{b}'), '[\\p{{L}}\\p{{N}}]+')"


CORPUS = """lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT d.doc_id, 'knowledge/' || source || '/' || d.doc_id || '.md' AS path, source AS title, source AS collection, lang AS namespace,
  CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'candidate' ELSE 'evidence' END AS status, CASE WHEN toxic = 1 THEN 'ingested' ELSE 'authored' END AS trust, text
  FROM documents d LEFT JOIN lab USING (doc_id)),
cut AS (SELECT doc_id, path, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls FROM docs),
chunks AS (SELECT path || '#/' || (i - 1) AS anchor, doc_id, path, i - 1 AS ordinal, rtrim(ls[i], ' ') AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM cut))"""


def _tokens(column: str) -> str:
    return _fold() % column


TERMS = "list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1, 64)"
ASKED = f"asked AS (SELECT item_id AS query_id, CASE WHEN len(list_filter({TERMS}, lambda t: t NOT IN (@STOP@))) > 0 THEN list_filter({TERMS}, lambda t: t NOT IN (@STOP@)) ELSE {TERMS} END AS terms FROM benchmark)"


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = tables.documents(spark, sf_dir)
    return docs, tables.chunks(docs)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = _corpus(spark, sf_dir)
    return chunks.join(docs.select("doc_id", "path", "title", "collection", "namespace", "status", "trust"), "doc_id")


# Corpus


@query("WITH @CORPUS@ SELECT doc_id, path, title, collection, namespace, status, trust FROM docs")
def corpus_documents(spark, sf_dir):
    return tables.documents(spark, sf_dir).drop("text")


@query("WITH @CORPUS@ SELECT anchor, doc_id, ordinal, 'sha256:' || sha256(text) AS chunk_digest FROM chunks")
def chunk_paragraphs(spark, sf_dir):
    return _corpus(spark, sf_dir)[1].select("anchor", "doc_id", "ordinal", "chunk_digest")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug FROM part""")
def heading_slug_ascii(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def document_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""WITH h AS (SELECT page_id, sha256(url) AS h FROM pages)
SELECT page_id, '0000000000' || list_aggregate(list_transform(range(16), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ',
  1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS ulid FROM h""")
def derived_ulids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.derived_ulid(F.col("url")).alias("ulid"))


@query("""SELECT doc_id, CASE WHEN length(text) > 320 THEN rtrim(substr(text, 1, 317), ' ') || '...' ELSE text END AS snippet FROM documents""")
def text_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.snippet(F.col("text")).alias("snippet"))


@query("WITH @CORPUS@ SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY doc_id")
def document_stats(spark, sf_dir):
    return _corpus(spark, sf_dir)[1].groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT 'documents' AS artifact, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings
UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'messages', count(*) FROM conversations""")
def artifact_counts(spark, sf_dir):
    named = {"documents": "documents", "vectors": "embeddings", "pages": "pages", "messages": "conversations"}
    one = [table(spark, sf_dir, t).agg(F.lit(a).alias("artifact"), F.count("*").alias("n")) for a, t in named.items()]
    return one[0].unionAll(one[1]).unionAll(one[2]).unionAll(one[3])


@query("SELECT label AS model_id, count(*) AS vectors FROM embeddings GROUP BY label")
def vectors_per_model(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("model_id")).agg(F.count("*").alias("vectors"))


@query("""WITH e AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS o, sha256(coalesce(text, '')) AS c FROM documents), b AS (SELECT substr(o, 1, 1) AS b, sha256(string_agg(o || c, chr(10) ORDER BY o, c)) AS d FROM e GROUP BY 1)
SELECT sha256(string_agg(b || d, chr(10) ORDER BY b)) AS digest FROM b""")
def corpus_fingerprint(spark, sf_dir):
    return lifecycle.corpus_digest(table(spark, sf_dir, "documents"), "doc_id", "text")


# Lexical leg


@query(f"WITH @CORPUS@, t AS (SELECT doc_id, unnest(list_distinct({_tokens('text')})) AS term FROM chunks) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS rows_with FROM t GROUP BY term")
def postings_df(spark, sf_dir):
    return lexical.document_frequency(_corpus(spark, sf_dir)[1])


def _bm25_sql(title: bool, where: str = "true") -> str:
    second = f"UNION ALL SELECT anchor, unnest({_tokens('title')}), 3.0::DOUBLE FROM rowz" if title else ""
    length = f"len({_tokens('text')})" + (f" + len({_tokens('title')})" if title else "")
    return f"""WITH @CORPUS@, rowz AS (SELECT c.*, d.title, d.collection, d.namespace, d.status, d.trust FROM chunks c JOIN docs d USING (doc_id)),
{ASKED}, post AS (SELECT anchor, unnest({_tokens('text')}) AS term, 1.0::DOUBLE AS w FROM rowz {second}),
f AS (SELECT anchor, term, sum(w) AS f FROM post GROUP BY anchor, term), df AS (SELECT term, count(*) AS n FROM f GROUP BY term),
l AS (SELECT anchor, {length} AS dl FROM rowz), st AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM l),
a AS (SELECT query_id, unnest(terms) AS t FROM asked), b AS (SELECT query_id, {_tokens('t')}[1] AS term FROM a),
s AS (SELECT query_id, anchor, round(sum((CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n + 0.5) / (n + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM b JOIN f USING (term) JOIN df USING (term) JOIN l USING (anchor) JOIN rowz USING (anchor) CROSS JOIN st WHERE {where} GROUP BY query_id, anchor),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS INTEGER) AS rank FROM s) SELECT query_id, anchor, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


@query(_bm25_sql(False))
def bm25_single_field_topk(spark, sf_dir):
    return lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0}, 10)


@query(_bm25_sql(True))
def bm25_fielded_repeated_arms(spark, sf_dir):
    return lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0, "title": 3.0}, 10)


@query(_bm25_sql(True))
def bm25_stored_index(spark, sf_dir):
    """The same from a stored index of three segments: half of the rows, then the others with some of the first brought again, and
    rows that were in it for a while deleted."""
    # a chunk's title is its document's own, so texts needn't meet other tables
    rows = tables.chunks(tables.named(spark, sf_dir).filter("doc_id IS NOT NULL"), "title").select("anchor", "doc_id", "text", "title")
    found = inverted.Index(spark, f"{work.folder(spark)}/index-{uuid.uuid4().hex}", ["text", "title"], stemmed=False)
    wrong = rows.filter("doc_id % 4 = 0").withColumn("text", F.concat("text", F.lit(" "), "text"))
    stray = rows.filter("doc_id % 8 = 1").withColumn("anchor", F.concat(F.lit("stray/"), "anchor"))
    found.update(rows.filter("doc_id % 4 = 2").unionByName(wrong).unionByName(stray))
    found.update(rows.filter("doc_id % 4 <> 2"))
    found.update(void=stray.select(F.col("anchor").alias("key")))
    return found.bm25(_asked(spark, sf_dir), {"text": 1.0, "title": 3.0}, 10)


@query()
def bm25_with_stems(spark, sf_dir):
    return lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0, "title": 3.0}, 10, stemmed=True)


@query(_bm25_sql(True, "status IN ('verified', 'evidence') AND collection = 'src0'"))
def filtered_search(spark, sf_dir):
    keep = retrieval.search_filter(collection="src0", status=retrieval.served(None, False))
    return lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0, "title": 3.0}, 10, keep=keep)


@query(f"""WITH {ASKED}, a AS (SELECT query_id, unnest(terms) AS t FROM asked), b AS (SELECT DISTINCT query_id, {_tokens('t')}[1] AS term FROM a),
held AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM documents) SELECT item_id AS query_id, item_id IN (SELECT query_id FROM b JOIN held USING (term)) AS answerable FROM benchmark""")
def foothold_abstention(spark, sf_dir):
    return lexical.footholds(_asked(spark, sf_dir), table(spark, sf_dir, "documents"))


@query(f"""WITH @CORPUS@, {ASKED}, a AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked), h AS (SELECT doc_id, unnest(list_distinct({_tokens('text')})) AS term FROM chunks),
c AS (SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS rows_with FROM h GROUP BY term)
SELECT query_id, term, coalesce(documents, 0) AS documents, coalesce(rows_with, 0) AS rows_with FROM a LEFT JOIN c USING (term)""")
def term_hits_report(spark, sf_dir):
    return lexical.term_report(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1])


_GREP = """a AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM asked), h AS (SELECT anchor, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM chunks),
wt AS (SELECT word, term FROM (SELECT DISTINCT word FROM h) JOIN (SELECT DISTINCT term FROM a) ON starts_with(word, term)),
hn AS (SELECT anchor, term, count(*) AS n FROM h JOIN wt USING (word) GROUP BY anchor, term), g AS (SELECT query_id, anchor, count(*) AS distinct_terms, CAST(sum(n) AS BIGINT) AS occurrences FROM a JOIN hn USING (term) GROUP BY query_id, anchor),
grepped AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distinct_terms DESC, occurrences DESC, anchor) AS INTEGER) AS rank FROM g)"""


@query(f"WITH @CORPUS@, {ASKED}, {_GREP} SELECT query_id, anchor, distinct_terms, occurrences, rank FROM grepped WHERE rank <= 10")
def grep_baseline_topk(spark, sf_dir):
    return lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 10)


# Vector leg and fusion

_KNN = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM u),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_inner_product(q.v, c.v), 9) AS score FROM e q CROSS JOIN e c),
knn AS (SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p.score DESC, vec_id) AS INTEGER) AS rank FROM p)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(f"WITH {_KNN} SELECT query_id, vec_id, score, rank FROM knn WHERE rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return retrieval.knn(v, v, 10)


@query("SELECT DISTINCT sha256(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embed_worklist_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(held, "doc_id", "left_anti").select("digest").distinct()


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def orphan_vectors_semi(spark, sf_dir):
    live = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(live, "vec_id", "left_semi")


@query(f"""WITH {_KNN}, v50 AS (SELECT query_id, vec_id AS anchor, rank FROM knn WHERE rank <= 50), legs AS (SELECT query_id, 'vector' AS leg, anchor, rank FROM v50
UNION ALL SELECT query_id, 'label', anchor, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) FROM v50 JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = anchor AND c.label = q.label),
s AS (SELECT query_id, anchor, CAST(sum(CAST(round((CASE WHEN leg = 'label' THEN 0.9 ELSE 1.0 END)::DOUBLE / (60 + rank), 12) AS DECIMAL(20, 12))) AS DOUBLE) AS score, count(*) AS n_legs FROM legs GROUP BY query_id, anchor),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, anchor) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 20""")
def rrf_fusion(spark, sf_dir):
    """The vector leg, and a leg of those of its hits that have the query's label."""
    v = _vectors(spark, sf_dir)
    hits = retrieval.knn(v, v, 50).select("query_id", F.col("vec_id").alias("anchor"), "rank")
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    same = hits.join(label.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(label.withColumnsRenamed({"vec_id": "anchor", "label": "al"}), "anchor").filter("ql = al")
    other = same.select("query_id", F.lit("label").alias("leg"), "anchor", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
    return retrieval.rrf(hits.select("query_id", F.lit("vector").alias("leg"), "anchor", "rank").unionByName(other), 20, {"label": 0.9}).select("query_id", "anchor", "score", "n_legs", "rank")


@query()
def search_batched(spark, sf_dir):
    docs, chunks = _corpus(spark, sf_dir)
    return search(_asked(spark, sf_dir), docs, chunks, Settings(limit=8)).select("query_id", "rank", "anchor", "score", "n_legs", "path", "status", "snippet", "tokens")


@query(f"""WITH q AS (SELECT conv_id, turn, text FROM conversations),
n AS (SELECT conv_id, turn, text, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_./:+-]+'), lambda t: regexp_matches(t, '^[A-Za-z_.][A-Za-z0-9_.:/+-]*$') AND NOT regexp_matches(t, '^[vV]?[0-9]+(\\.[0-9]+)+$')
  AND regexp_matches(t, '[A-Za-z]') AND (contains(t, '_') OR contains(t, '.') OR contains(t, '/') OR contains(t, '::') OR regexp_matches(t, '[a-z][A-Z]')))) > 0 OR regexp_matches(text, '"[^"]+"|''[^'']+''') AS name,
  {" OR ".join(f"contains(lower(text), '{p}')" for p in planner.RELATIONSHIP_PHRASES)} AS relation FROM q)
SELECT conv_id, turn, name AS identifier, relation AS relationship FROM n""")
def planner_rules(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    has = lambda r: F.array_contains("rules", r)
    return planner.plan(asked).select("conv_id", "turn", has("identifier").alias("identifier"), has("relationship").alias("relationship"))


_SHELL = "'^[a-z][a-z0-9-]*$'"


@query(f"""WITH q AS (SELECT conv_id, turn, text, regexp_extract(trim(text), '^["''`](.+)["''`]$', 1) AS whole FROM conversations),
w AS (SELECT *, list_filter(list_transform(string_split_regex(trim(CASE WHEN whole <> '' THEN whole ELSE text END), '\\s+'), lambda w: trim(w, '{planner.MARKS.replace(chr(39), chr(39) * 2)}')), lambda w: w <> '') AS words FROM q),
z AS (SELECT *, list_position(list_transform(words, lambda w: regexp_matches(w, {_SHELL})), false) AS stop FROM w),
y AS (SELECT *, least(CASE WHEN stop > 0 THEN stop - 1 ELSE len(words) END, 5) AS size FROM z),
n AS (SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_./:+-]+'), lambda t: regexp_matches(t, '^[A-Za-z_.][A-Za-z0-9_.:/+-]*$') AND NOT regexp_matches(t, '^[vV]?[0-9]+(\\.[0-9]+)+$')
  AND regexp_matches(t, '[A-Za-z]') AND (contains(t, '_') OR contains(t, '.') OR contains(t, '/') OR contains(t, '::') OR regexp_matches(t, '[a-z][A-Z]')))) > 0 OR regexp_matches(text, '"[^"]+"|''[^'']+''') AS name,
  NOT regexp_matches(text, '"[^"]+"|''[^'']+''') AND size > 0 AND (whole <> '' OR (len(list_filter(words[size + 1:], lambda w: regexp_matches(w, {_SHELL}))) = 0 AND len(list_filter(words[:size], lambda w: w IN (@STOP@))) = 0)) AS shell,
  {" OR ".join(f"contains(lower(text), '{p}')" for p in planner.RELATIONSHIP_PHRASES)} AS relation FROM y)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN name THEN 'identifier' END, CASE WHEN shell THEN 'command' END, CASE WHEN relation THEN 'relationship' END, CASE WHEN NOT name AND NOT shell AND NOT relation THEN 'natural-language' END], lambda x: x IS NOT NULL), ',') AS rules,
  array_to_string(list_filter([CASE WHEN relation THEN 'graph' END, 'lexical', CASE WHEN name OR shell THEN 'symbol' END, 'vector'], lambda x: x IS NOT NULL), ',') AS generators FROM n""")
def planner_generators(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return planner.plan(asked).select("conv_id", "turn", F.array_join("rules", ",").alias("rules"), F.array_join("generators", ",").alias("generators"))


@query(f"""WITH @CORPUS@, {ASKED}, {_GREP}, k AS (SELECT query_id, anchor, distinct_terms, rank, regexp_replace(anchor, '#.*$', '') AS doc FROM grepped WHERE rank <= 50),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) AS n FROM k), r AS (SELECT query_id, anchor, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank FROM c WHERE n <= 1)
SELECT * FROM r WHERE rank <= 10""")
def rerank_document_cap(spark, sf_dir):
    hits = lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 50).withColumn("doc", F.regexp_replace("anchor", "#.*$", ""))
    return retrieval.document_cap(hits, 1).select("query_id", "anchor", "rank")


@query(f"""WITH @CORPUS@, {ASKED}, {_GREP}, k AS (SELECT query_id, anchor, distinct_terms, rank AS old, regexp_replace(anchor, '#.*$', '') AS doc FROM grepped WHERE rank <= 50),
c AS (SELECT *, round(distinct_terms * pow(0.5, row_number() OVER (PARTITION BY query_id, doc ORDER BY old) - 1), 6) AS score FROM k),
r AS (SELECT query_id, anchor, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""")
def rerank_document_decay(spark, sf_dir):
    hits = lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 50).withColumn("doc", F.regexp_replace("anchor", "#.*$", "")).withColumn("score", F.col("distinct_terms").cast("double"))
    return retrieval.document_decay(hits, 0.5).select("query_id", "anchor", "score", "rank")


@query(f"""WITH RECURSIVE @CORPUS@, {ASKED}, {_GREP}, hit AS (SELECT g.query_id, g.rank, g.anchor, len(regexp_extract_all(c.text, '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens FROM grepped g JOIN chunks c USING (anchor) WHERE g.rank <= 50),
p AS (SELECT query_id, 0 AS rank, 0::BIGINT AS spent, 0 AS kept, 0 AS omitted FROM hit GROUP BY query_id
UNION ALL SELECT p.query_id, h.rank, CASE WHEN p.spent + h.tokens <= 400 THEN p.spent + h.tokens ELSE p.spent END, CASE WHEN p.spent + h.tokens <= 400 THEN p.kept + 1 ELSE p.kept END, CASE WHEN p.spent + h.tokens <= 400 THEN p.omitted ELSE p.omitted + 1 END
FROM p JOIN hit h ON h.query_id = p.query_id AND h.rank = p.rank + 1),
last AS (SELECT query_id, max(rank) AS n, max(spent) AS spent, max(kept) AS kept, max(omitted) AS omitted FROM p GROUP BY query_id), f AS (SELECT query_id, tokens > 400 AS exceeded FROM hit WHERE rank = 1)
SELECT query_id, CAST(CASE WHEN exceeded THEN 0 ELSE spent END AS BIGINT) AS spent, exceeded, CAST(CASE WHEN exceeded THEN 0 ELSE kept END AS INTEGER) AS n_kept, CAST(CASE WHEN exceeded THEN n ELSE omitted END AS INTEGER) AS n_omitted FROM last JOIN f USING (query_id)""")
def budget_pack(spark, sf_dir):
    chunks = _corpus(spark, sf_dir)[1]
    hits = lexical.grep(_asked(spark, sf_dir), chunks, 50).join(chunks.select("anchor", "tokens"), "anchor")
    packed = retrieval.pack(hits, 400)
    return packed.select("query_id", "spent", "exceeded", F.size("kept").alias("n_kept"), F.size("omitted").alias("n_omitted"))


# Graph

LINKS = """got AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS path, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: x) AS ts FROM pages),
links AS (SELECT page_id, path, i - 1 AS ord, ts[i] AS target FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM got)),
files AS (SELECT DISTINCT regexp_replace(path, '^/+', '') AS path FROM got),
als AS (SELECT lower('/' || split_part(regexp_extract(html, '<title>([^<]*)', 1), ' ', 1)) AS ak, min(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '^/+', '')) AS ap,
  count(DISTINCT regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '^/+', '')) AS an FROM pages GROUP BY 1),
base AS (SELECT regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS k, min(path) AS p, count(*) AS n FROM files GROUP BY 1),
res AS (SELECT l.*, regexp_replace(target, '#.*$', '') AS bare, lower(regexp_extract(target, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto', 'ftp', 'ftps', 'data', 'tel', 'file') AS ext FROM links l),
r2 AS (SELECT r.*, e.path AS ep, b.p AS bp, b.n AS bn, ap, an FROM res r LEFT JOIN als ON ak = lower(bare) LEFT JOIN files e ON e.path = regexp_replace(bare, '^/+', '') LEFT JOIN base b ON b.k = regexp_replace(list_last(string_split(bare, '/')), '\\.[^.]*$', '')),
resolved AS (SELECT page_id, path, ord, target, CASE WHEN ext THEN NULL WHEN bare = '' THEN regexp_replace(path, '^/+', '') WHEN ep IS NOT NULL THEN ep WHEN bn = 1 THEN bp WHEN bn > 1 THEN NULL WHEN an = 1 THEN ap END AS to_path, ext, bn, an FROM r2),
pairs AS (SELECT 'doc:' || regexp_replace(path, '^/+', '') AS source, 'doc:' || to_path AS target, min(ord) AS ord FROM resolved WHERE to_path IS NOT NULL GROUP BY 1, 2),
edges AS (SELECT 'sha256:' || sha256('[' || to_json(source)::VARCHAR || ',' || to_json(target)::VARCHAR || ',"links_to","sha256:' || sha256('{"anchor":null,"kind":"markdown_link"}') || '"]') AS edge_id, source, target, 'links_to' AS type, ord FROM pairs)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_links(table(spark, sf_dir, "pages"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*", ""), r"[?#].*$", "").alias("path")).distinct()
    word = F.split_part(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" "), F.lit(1))  # a title's first word is the page's alias
    aliases = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), word).alias("alias"), F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]*", ""), r"[?#].*$", ""), "^/+", "").alias("path"))
    return graph.resolve(links, pages, aliases)


@query("WITH @LINKS@ SELECT page_id, path, ord, target FROM links")
def page_links(spark, sf_dir):
    return _links(spark, sf_dir)


@query("WITH @LINKS@ SELECT page_id, ord, target, to_path FROM resolved WHERE to_path IS NOT NULL")
def resolved_links(spark, sf_dir):
    return _resolved(spark, sf_dir).filter("to_path is not null").select("page_id", "ord", "target", "to_path")


@query("""WITH @LINKS@ SELECT reason, count(*) AS links FROM (SELECT CASE WHEN ext THEN 'external' WHEN to_path IS NOT NULL THEN 'resolved' WHEN bn > 1 THEN 'ambiguous name' WHEN an > 1 THEN 'ambiguous alias' ELSE 'no such document' END AS reason FROM resolved) GROUP BY reason""")
def unresolved_reasons(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("links"))


@query("WITH @LINKS@ SELECT edge_id, source, target, type, ord FROM edges")
def edges_dedupe_digest(spark, sf_dir):
    return graph.edges(_resolved(spark, sf_dir)).select("edge_id", "source", "target", "type", "ord")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("target"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")).alias("target"))
    return n.unionByName(s).withColumn("type", F.lit("part_of")).withColumn("edge_id", X.digest(F.concat_ws("|", "source", "target", "type")))


@query("""WITH e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
i AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e), d1 AS (SELECT 'region:' || r_regionkey AS origin, other AS node FROM region JOIN i ON i.node = 'region:' || r_regionkey),
d2 AS (SELECT DISTINCT origin, other AS node FROM d1 JOIN i USING (node))
SELECT origin, node, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT origin, node, 1 AS depth FROM d1 UNION ALL SELECT origin, node, 2 FROM d2) WHERE node <> origin GROUP BY origin, node""")
def neighbours_depth2(spark, sf_dir):
    origins = table(spark, sf_dir, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("origin"))
    return graph.neighbours(origins, _nations(spark, sf_dir), 2)


@query("""WITH e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
i AS (SELECT a AS node, b AS other, 'out' AS dir, sha256(a || '|' || b || '|part_of') AS id FROM e UNION ALL SELECT b, a, 'in', sha256(a || '|' || b || '|part_of') FROM e),
s AS (SELECT * FROM (SELECT s_nationkey AS query_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS seed_rank, 'supplier:' || s_suppkey AS node FROM supplier) WHERE seed_rank <= 10),
m AS (SELECT query_id, seed_rank, other, row_number() OVER (PARTITION BY query_id, seed_rank ORDER BY dir DESC, other, id) AS round FROM s JOIN i USING (node) WHERE other <> node),
f AS (SELECT query_id, other AS node, min((round, seed_rank)) AS spot FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, node) AS n FROM f)
SELECT query_id, node, CAST(spot[2] AS INTEGER) AS seed_rank, CAST(spot[1] AS INTEGER) AS round FROM r WHERE n <= 10""")
def graph_round_robin(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("seed_rank"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node")).filter("seed_rank <= 10")
    return graph.round_robin(seeds, _nations(spark, sf_dir)).select("query_id", "node", "seed_rank", "round")


@query(f"""WITH @CORPUS@, w AS (SELECT {_tokens('text')} AS ws FROM benchmark), k AS (SELECT ws, unnest(range(1, len(ws))) AS k FROM w), names AS (SELECT DISTINCT ws[k] || ' ' || ws[k + 1] AS name, ws[k] || ' ' || ws[k + 1] AS gram FROM k WHERE length(ws[k] || ' ' || ws[k + 1]) >= 4),
c AS (SELECT doc_id, ordinal, {_tokens('text')} AS ts FROM chunks), g AS (SELECT doc_id, ordinal, ts, unnest(range(1, len(ts))) AS k FROM c)
SELECT name AS slug, doc_id, min(ordinal) AS ordinal FROM g JOIN names ON gram = ts[k] || ' ' || ts[k + 1] GROUP BY name, doc_id""")
def entity_mentions(spark, sf_dir):
    """Every two neighbouring words of an item are a name."""
    words = table(spark, sf_dir, "benchmark").select(X.index_tokens(F.col("text")).alias("t")).filter(F.size("t") >= 2)
    names = words.select(F.explode(graph.ngrams("t", 2)).alias("name")).distinct()
    return graph.entity_mentions(names.select(F.col("name").alias("slug"), "name"), _corpus(spark, sf_dir)[1]).select("slug", "doc_id", "ordinal")


_NAMES = "regexp_extract_all(p_name || ' ' || p_brand || '.' || p_type, '[A-Za-z0-9_./:+-]+')"


@query("""WITH d AS (SELECT p_brand AS symbol, p_type AS kind, p_size % 2 = 0 AS direct, p_name AS path, p_size AS line, p_name || '#/' || p_partkey AS anchor FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY NOT direct, path, line, kind, anchor) AS n FROM d)
SELECT symbol, max(CASE WHEN n = 1 THEN kind END) AS kind, max(CASE WHEN n = 1 THEN anchor END) AS defined_in, count(DISTINCT anchor) AS refs FROM r GROUP BY symbol""")
def identifier_symbols_fold(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("kind"), (F.col("p_size") % 2 == 0).alias("direct"), F.col("p_name").alias("path"), F.col("p_size").alias("line"), F.concat("p_name", F.lit("#/"), F.col("p_partkey").cast("string")).alias("anchor"))
    return graph.fold_symbols(p).select("symbol", "kind", "defined_in", F.size("doc_refs").cast("long").alias("refs"))


# Compiled pages: HTML blocks, their Markdown, and its nodes and chunks


@query()
def page_blocks(spark, sf_dir):
    return html.blocks(table(spark, sf_dir, "pages"))


def _page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.to_markdown(html.blocks(table(spark, sf_dir, "pages")))
    return text.select(F.concat(F.lit("evidence/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query()
def page_node_kinds(spark, sf_dir):
    return markdown.nodes(_page_markdown(spark, sf_dir)).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query()
def page_chunks(spark, sf_dir):
    return markdown.chunks(_page_markdown(spark, sf_dir)).select("anchor", "kind", "tokens", "chunk_digest")


# Evaluation: a benchmark item is a case; a chunk that holds one of its lines, whole, is relevant

EVAL = f"""@CORPUS@, il AS (SELECT item_id AS case_id, unnest(string_split(text, chr(10))) AS line FROM benchmark),
il2 AS (SELECT DISTINCT case_id, list_aggregate({_tokens('line')}, 'string_agg', ' ') AS gram FROM il WHERE len({_tokens('line')}) >= 1),
ct AS (SELECT anchor, ' ' || list_aggregate({_tokens('text')}, 'string_agg', ' ') || ' ' AS s FROM chunks),
judged AS (SELECT case_id, anchor, CAST(max(1 + length(gram) % 3) AS INTEGER) AS grade FROM il2 JOIN ct ON contains(s, ' ' || gram || ' ') GROUP BY case_id, anchor), {ASKED}, {_GREP},
got AS (SELECT query_id AS case_id, g.rank, j.grade FROM grepped g JOIN judged j ON j.case_id = g.query_id AND j.anchor = g.anchor WHERE g.rank <= 10),
dcg AS (SELECT case_id, sum(CAST(round((pow(2.0, grade) - 1) / log2(rank + 1.0), 9) AS DECIMAL(20, 9))) AS dcg, count(*) AS hits, min(rank) AS first FROM got GROUP BY case_id),
jr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, anchor) AS p FROM judged),
ideal AS (SELECT case_id, sum(CASE WHEN p <= 10 THEN CAST(round((pow(2.0, grade) - 1) / log2(p + 1.0), 9) AS DECIMAL(20, 9)) END) AS ideal, count(*) AS n FROM jr GROUP BY case_id),
m AS (SELECT case_id, round(coalesce(CAST(dcg AS DOUBLE) / CAST(ideal AS DOUBLE), 0), 6) AS ndcg, round(coalesce(hits / CAST(n AS DOUBLE), 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM ideal LEFT JOIN dcg USING (case_id))"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cases, judged)."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    lines = items.select("case_id", F.explode(F.split("text", "\n")).alias("line")).select("case_id", X.index_tokens(F.col("line")).alias("tokens")).filter(F.size("tokens") >= 1)
    lines = lines.withColumn("line", F.array_join("tokens", " ")).distinct()
    near = lexical.passages(lines, _corpus(spark, sf_dir)[1])
    judged = near.join(lines, "line").groupBy("case_id", "anchor").agg(F.max(F.length("line") % 3 + 1).alias("grade"))
    judged = work.written(judged, "judged")
    some = judged.select("case_id").distinct().withColumn("answerable", F.lit(True))
    return items.join(some, "case_id", "left").select("case_id", F.coalesce("answerable", F.lit(False)).alias("answerable"), "text"), judged


def _grep_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, judged = _cases(spark, sf_dir)
    results = lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 10).select(F.col("query_id").alias("case_id"), "rank", "anchor")
    return evaluation.metrics(results, judged, cases)


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.explode(F.array(F.when(size < 250, "short").otherwise("long"), F.concat(F.lit("mod"), (F.col("item_id") % 3).cast("string")))).alias("slice"))


_SLICED = "sl AS (SELECT item_id AS case_id, unnest([CASE WHEN length(text) < 250 THEN 'short' ELSE 'long' END, 'mod' || (item_id % 3)]) AS slice FROM benchmark), ms AS (SELECT slice, m.* FROM m JOIN sl USING (case_id))"


@query("WITH @EVAL@ SELECT case_id, ndcg, recall, rr FROM m")
def eval_ndcg_recall_mrr(spark, sf_dir):
    return _grep_metrics(spark, sf_dir)


@query(f"""WITH @EVAL@, {_SLICED}, al AS (SELECT 'ALL' AS slice, * FROM m UNION ALL SELECT * FROM ms)
SELECT slice, count(*) AS cases, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr FROM al GROUP BY slice""")
def eval_per_slice(spark, sf_dir):
    return evaluation.summary(_grep_metrics(spark, sf_dir), _slices(spark, sf_dir))


@query()
def eval_search(spark, sf_dir):
    cases, judged = _cases(spark, sf_dir)
    hits = lexical.bm25(_asked(spark, sf_dir), _rows(spark, sf_dir), {"text": 1.0, "title": 3.0}, 10, stemmed=True)
    return evaluation.metrics(hits.select(F.col("query_id").alias("case_id"), "rank", "anchor"), judged, cases)


@query("""WITH @EVAL@, un AS (SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT case_id FROM judged)), f AS (SELECT count(*) AS unanswerable, count(*) FILTER (WHERE item_id IN (SELECT query_id FROM g)) AS false_answers FROM un),
r AS (SELECT *, CASE WHEN unanswerable > 0 THEN round(false_answers / unanswerable, 6) ELSE 0.0 END AS rate FROM f) SELECT unanswerable, false_answers, CAST(rate AS DOUBLE) AS rate, rate <= 0.05 AS passed FROM r""")
def gate_g4_abstention(spark, sf_dir):
    cases, _ = _cases(spark, sf_dir)
    answered = lexical.grep(_asked(spark, sf_dir), _corpus(spark, sf_dir)[1], 1).select(F.col("query_id").alias("case_id"))
    return evaluation.abstention(cases, answered)


@query(f"""WITH @EVAL@, {_SLICED}, s AS (SELECT slice, count(*) AS n, avg(ndcg) AS mean, list_sort(list(ndcg) FILTER (WHERE ndcg > 0)) AS nz FROM ms GROUP BY slice),
k AS (SELECT slice, n, CAST(CASE WHEN len(nz) > 0 AND mean > 0 THEN ceil(nz[len(nz) // 2 + 1] / (0.02 * mean)) ELSE 4 END AS BIGINT) AS needed FROM s) SELECT slice, n, needed, n >= needed AS armed FROM k""")
def enforceable_slice_size(spark, sf_dir):
    m = _grep_metrics(spark, sf_dir).join(_slices(spark, sf_dir), "case_id")
    return evaluation.needed_cases(m, "slice", "ndcg")


@query("""SELECT l_returnflag AS grp, count(*) FILTER (WHERE (l_quantity > 25) AND NOT (l_discount > 0.05)) AS wins, count(*) FILTER (WHERE NOT (l_quantity > 25) AND (l_discount > 0.05)) AS losses FROM lineitem GROUP BY 1""")
def sign_test_counts(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_quantity") > 25).cast("int").alias("a"), (F.col("l_discount") > 0.05).cast("int").alias("b"))
    return evaluation.sign_test(pairs, "grp", "a", "b").select("grp", "wins", "losses")


@query("""WITH n AS (SELECT o_orderpriority AS grp, count(*) FILTER (WHERE o_totalprice % 7 > o_totalprice % 5) AS wins, count(*) FILTER (WHERE o_totalprice % 7 < o_totalprice % 5) AS losses FROM orders GROUP BY 1),
k AS (SELECT *, wins + losses AS m, unnest(range(wins, wins + losses + 1)) AS k FROM n)
SELECT grp, wins, losses, round(sum(exp(lgamma(m + 1.0) - lgamma(k + 1.0) - lgamma(m - k + 1.0) - m * ln(2.0))), 9) AS p FROM k GROUP BY grp, wins, losses""")
def sign_test_verdict(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") % 7).alias("a"), (F.col("o_totalprice") % 5).alias("b"))
    return evaluation.sign_test(pairs, "grp", "a", "b")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN k = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN value END) AS p50, max(CASE WHEN k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_p50_p95(spark, sf_dir):
    return evaluation.latency(table(spark, sf_dir, "events"), "event_type", "value")


# Conversations


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.numbered(table(spark, sf_dir, "conversations"))


_ROLE = "CASE " + " ".join(f"WHEN lower(trim(role)) IN ({', '.join(repr(w) for w in ws)}) THEN '{r}'" for r, ws in chats.ROLES.items()) + " ELSE 'user' END"
_MSG = f"msg AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, {_ROLE} AS role, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{X.ESTIMATE.replace(chr(39), chr(39) * 2)}')) AS tokens FROM conversations)"


@query(f"""WITH {_MSG}, b AS (SELECT *, row_number() OVER w AS n, sum(tokens) OVER w AS t FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY seq DESC))
SELECT conv_id, seq, role, tokens FROM b WHERE n = 1 OR t <= 200""")
def conversation_tail(spark, sf_dir):
    return chats.tail(_messages(spark, sf_dir), tokens=200).select("conv_id", "seq", "role", "tokens")


@query(f"WITH {_MSG} SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens FROM msg GROUP BY conv_id")
def participants(spark, sf_dir):
    return chats.participants(_messages(spark, sf_dir)).withColumn("roles", F.array_join("roles", ","))


@query(f"""WITH {_MSG}, s AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY seq) = role THEN 0 ELSE 1 END AS st FROM msg), t AS (SELECT *, CAST(sum(st) OVER (PARTITION BY conv_id ORDER BY seq) AS BIGINT) AS turn FROM s)
SELECT conv_id, turn, min(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM t GROUP BY conv_id, turn""")
def merged_turns(spark, sf_dir):
    return chats.merged_turns(_messages(spark, sf_dir))


@query(f"""WITH {_MSG} SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY seq) AS payload FROM msg GROUP BY conv_id""")
def chat_markdown_export(spark, sf_dir):
    return chats.export(_messages(spark, sf_dir), "markdown")


@query(f"""WITH {_MSG} SELECT conv_id, CAST(json_object('messages', list(json_object('role', role, 'content', text) ORDER BY seq)) AS VARCHAR) AS payload FROM msg GROUP BY conv_id""")
def chat_openai_export(spark, sf_dir):
    return chats.export(_messages(spark, sf_dir))


@query(f"""WITH {_MSG} SELECT conv_id, CAST(json_object('system', coalesce(string_agg(text, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE role = 'system'), ''),
  'messages', coalesce(list(json_object('role', role, 'content', text) ORDER BY seq) FILTER (WHERE role <> 'system'), [])) AS VARCHAR) AS payload FROM msg GROUP BY conv_id""")
def chat_anthropic_export(spark, sf_dir):
    return chats.export(_messages(spark, sf_dir), "anthropic")


# Lifecycle and ingestion


@query("""WITH e AS (SELECT 'user:' || user_id AS source_uri, event_id AS seq, ts AS seen, event_type <> 'error' AS ok, event_type AS reason FROM events), c AS (SELECT source_uri, max(seq) AS cleared FROM e WHERE ok GROUP BY 1)
SELECT e.source_uri, arg_max(reason, seq) AS reason, count(*) AS failures, min(seen) AS first_seen, max(seen) AS last_seen FROM e LEFT JOIN c USING (source_uri) WHERE NOT ok AND (cleared IS NULL OR seq > cleared) GROUP BY e.source_uri""")
def quarantine_first_last_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return lifecycle.quarantine(e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_uri"), F.col("event_id").alias("seq"), F.col("ts").alias("seen"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("reason")))


_DEBOUNCED = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g),
p AS (SELECT *, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, session)) / 86400000000) AS BIGINT) AS part FROM s)
SELECT user_id, session, part, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM p GROUP BY user_id, session, part"""


@query(_DEBOUNCED)
def debounced_sessions(spark, sf_dir):
    return watch.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600, 86400, tie="event_id")


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The current state is every document; the previous one every labelled document, in which toxic ones differ, and
    every page, none of which is a document any more."""
    d, env = table(spark, sf_dir, "documents"), F.lit("env1").alias("env_digest")
    key = F.col("doc_id").cast("string").alias("doc_id")
    digest = F.sha2("text", 256)
    cur = d.select(F.concat(F.lit("doc/"), key).alias("path"), key, digest.alias("source_digest"), env)
    old = d.join(_labelled(spark, sf_dir), "doc_id").select(F.concat(F.lit("doc/"), key).alias("path"), key, F.when(F.col("toxic") == 1, "changed").otherwise(digest).alias("source_digest"), env)
    page = F.concat(F.lit("page/"), F.col("page_id").cast("string"))
    return cur, old.unionByName(table(spark, sf_dir, "pages").select(page.alias("path"), page.alias("doc_id"), F.sha2("html", 256).alias("source_digest"), env))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


_LAB = "lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)"


@query(f"""WITH {_LAB} SELECT 'doc/' || doc_id AS path, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN lab.doc_id IS NULL THEN 'new' WHEN toxic = 1 THEN 'rebuilt' ELSE 'reused' END AS action FROM documents LEFT JOIN lab USING (doc_id)
UNION ALL SELECT 'page/' || page_id, 'page/' || page_id, 'removed' FROM pages""")
def incremental_plan(spark, sf_dir):
    return lifecycle.incremental_plan(*_states(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, sha256(text) AS identity, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) SELECT doc_id, identity, n > 1 AS quarantined FROM r""")
def duplicate_identity_quarantine(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    first = d.groupBy("identity").agg(F.min("doc_id").alias("first"))
    return d.join(first, "identity").select("doc_id", "identity", (F.col("doc_id") != F.col("first")).alias("quarantined"))


@query(f"""WITH {_LAB} SELECT doc_id, CASE WHEN lab.doc_id IS NULL THEN 'gone' WHEN quality = 1 AND toxic = 1 THEN 'moved and rewritten' WHEN quality = 1 THEN 'moved' WHEN toxic = 1 THEN 'rewritten' ELSE 'current' END AS drift FROM documents LEFT JOIN lab USING (doc_id)""")
def citation_drift(spark, sf_dir):
    """Every document is cited; those of quality have since moved, toxic ones have changed, unlabelled ones are gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("anchor"), F.sha2("text", 256).alias("full"))
    cited = d.select("anchor", F.substring("full", 1, 12).alias("digest"), F.lit(1).alias("first"), F.lit(5).alias("last"))
    now = d.join(_labelled(spark, sf_dir), "doc_id").select("anchor", F.when(F.col("toxic") == 1, F.lit("-")).otherwise(F.col("full")).alias("digest"), F.when(F.col("quality") == 1, 2).otherwise(1).alias("first"), F.lit(5).alias("last"))
    return lifecycle.drift(cited, now).select(F.col("anchor").cast("long").alias("doc_id"), "drift")


@query("WITH @CORPUS@ SELECT anchor, 1 AS first, CAST(length(text) AS INTEGER) AS last, substr(sha256(text), 1, 12) AS digest, 'ok' AS status FROM chunks")
def citation_uris(spark, sf_dir):
    """Every chunk's citation, written and parsed again."""
    c = _corpus(spark, sf_dir)[1]
    written = c.select(citations.uri(F.col("anchor"), F.lit(1), F.length("text"), F.col("chunk_digest")).alias("uri"))
    return citations.parse(written).select("anchor", "first", "last", "digest", "status")


@query("""WITH @CORPUS@, lost AS (SELECT anchor FROM chunks WHERE length(text) < 40) SELECT count(*) AS lost, count(*) FILTER (WHERE regexp_replace(anchor, '/[^/]*$', '') IN (SELECT regexp_replace(anchor, '/[^/]*$', '') FROM chunks WHERE length(text) >= 40)) AS found FROM lost""")
def fetch_nearest(spark, sf_dir):
    """Short chunks are cited and gone; the nearest section above answers."""
    c = _corpus(spark, sf_dir)[1]
    lost, left = c.filter("length(text) < 40").select("anchor"), c.filter("length(text) >= 40").select("anchor", "text")
    got = citations.fetch(lost, left)
    return lost.join(got.select("anchor", F.lit(1).alias("f")), "anchor", "left").agg(F.count("*").alias("lost"), F.count("f").alias("found"))


def _re2(p: str) -> str:
    return p.replace("'", "''")


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, len(regexp_extract_all(text, '{_re2(p)}')) AS found FROM documents" for n, p in lifecycle.SECRET_RULES) + ") SELECT doc_id, rule, found FROM r WHERE found > 0")
def secret_scan(spark, sf_dir):
    return lifecycle.secrets(table(spark, sf_dir, "documents"))


def _redact_sql() -> str:
    out = "text"
    for n, p in lifecycle.SECRET_RULES:
        out = f"regexp_replace({out}, '{_re2(p)}', '[redacted: {n}]', 'g')"
    return f"SELECT doc_id, sha256({out}) AS digest FROM documents"


@query(_redact_sql())
def secret_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(lifecycle.redacted(F.col("text")), 256).alias("digest"))


_TAGS = "regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)"


@query(f"""WITH t AS (SELECT page_id, unnest({_TAGS}) AS tag FROM pages), s AS (SELECT page_id, CASE WHEN tag IN ('script', 'style', 'iframe') THEN 'lost' WHEN tag IN ('b', 'div', 'nav') THEN 'degraded' ELSE 'represented' END AS state FROM t),
b AS (SELECT page_id AS doc_id, count(*) AS elements, count(*) FILTER (WHERE state = 'represented') AS represented, count(*) FILTER (WHERE state = 'degraded') AS degraded, count(*) FILTER (WHERE state = 'lost') AS lost FROM s GROUP BY 1)
SELECT *, round(lost / elements, 6) AS loss, round(lost / elements, 6) <= 0.05 AS within FROM b""")
def fidelity_buckets(spark, sf_dir):
    tags = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    state = F.when(F.col("tag").isin("script", "style", "iframe"), "lost").when(F.col("tag").isin("b", "div", "nav"), "degraded").otherwise("represented")
    return lifecycle.fidelity(tags.select("doc_id", state.alias("state")), 0.05)


@query("SELECT page_id, len(regexp_extract_all(html, '<[A-Za-z!/]')) AS tags, CASE WHEN len(regexp_extract_all(html, '<[A-Za-z!/]')) > 100 THEN 'too many tags' END AS refused FROM pages")
def markup_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_count("html", F.lit("<[A-Za-z!/]")).cast("long").alias("tags"), lifecycle.markup_guard(F.col("html"), 100).alias("refused"))


@query("SELECT doc_id, sha256('audit/' || doc_id) AS place FROM documents ORDER BY place, doc_id LIMIT 100")
def deterministic_sample(spark, sf_dir):
    return lifecycle.sample(table(spark, sf_dir, "documents").select("doc_id"), "audit", 100, "doc_id")


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS snapshot_id, CAST(o_custkey AS VARCHAR) AS digest FROM orders), k AS (SELECT snapshot_id FROM (SELECT DISTINCT snapshot_id FROM s) ORDER BY snapshot_id DESC LIMIT 2)
SELECT CAST(c_custkey AS VARCHAR) AS digest, CAST(c_custkey AS VARCHAR) IN (SELECT digest FROM s WHERE snapshot_id IN (SELECT snapshot_id FROM k)) AS live FROM customer""")
def snapshot_gc_live_set(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("snapshot_id"), F.col("o_orderpriority").alias("made"), F.col("o_custkey").cast("string").alias("digest"))
    return lifecycle.live_set(named, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("digest")), 2)


@query("""SELECT sha256(text) AS digest, CAST(min(length(text)) AS BIGINT) AS size, min(lang) AS kind, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY 1""")
def custody_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kinds = d.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("lang").alias("kind"))
    rows = d.select(F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("size"), F.array("source").alias("sources"), F.col("doc_id").alias("first_seen"), F.col("doc_id").alias("last_seen")).join(kinds, "digest")
    return lifecycle.merge_custody(rows.limit(0), rows).withColumn("sources", F.array_join("sources", ","))


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS closes, count(*) AS events FROM s GROUP BY user_id, session""")
def stream_sessions(spark, sf_dir):
    """The sessions of a stream that has read all of the events table, from the stream's own state."""
    at = f"{work.folder(spark)}/sessions-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = watch.streamed_sessions(stream, "user_id", "ts", "6 hours", "1 day")
    spark.createDataFrame([], out.schema).write.parquet(f"{at}/rows")

    def held(batch: DataFrame, epoch: int) -> None:
        """All sessions of the state, those still open too; each epoch replaces the one before."""
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    run = out.writeStream.foreachBatch(held).outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query(_DEBOUNCED)
def stream_debounced(spark, sf_dir):
    """Debounced batches with a ceiling, from keyed state with timers: the stream reads all of the events table, and a tick after
    it closes what is still open."""
    at = f"{work.folder(spark)}/debounced-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "ts", F.lit(False).alias("tick"))
    spark.sql("SELECT -1L AS user_id, TIMESTAMP_NTZ '2200-01-01' AS ts, true AS tick").write.parquet(f"{at}/ticks/last")
    ticks = spark.readStream.schema(stream.schema).parquet(f"{at}/ticks/*")
    out = debounce.debounced(stream.unionByName(ticks), "user_id", "ts", 6 * 3600, 86400, "0 seconds", tick="tick")
    old = spark.conf.get(debounce.STORE_CONF)
    try:
        spark.conf.set(debounce.STORE_CONF, debounce.STORE)
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    finally:
        spark.conf.set(debounce.STORE_CONF, old)
    run.awaitTermination()
    rows = spark.read.schema(out.schema).parquet(f"{at}/rows")
    return rows.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("ended", F.col("ended").cast("timestamp_ntz"))


def _expanded(sql: str) -> str:
    for name, text in (("@EVAL@", EVAL), ("@LINKS@", LINKS), ("@CORPUS@", CORPUS), ("@STOP@", ", ".join(f"'{w}'" for w in X.STOPWORDS))):
        sql = sql.replace(name, text)
    return sql


from loomdex import record_queries  # noqa: E402, F401 - registers its queries with the functions above

ORACLES = {name: _expanded(sql) for name, sql in ORACLES.items()}
