"""Registered queries of the library's retrieval-data operators, with their SQL.

Every query reads whole tables. ``QUERIES`` and ``ORACLES`` share keys. Of the queries without SQL, the
parser and the chunker are held against plain versions of their steps in tests/; clean_inline is
held against the parser's own patterns, embed_search only by its metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import text as T
from tidewright.operators import chunking, qa, retrieval, splitting, training
from tidewright.plans import derive
from tidewright.plans.derive import QA_SQL, SECTIONS_SQL, TOP_SQL, table
from tidewright.sources import outline
from tidewright.sources.tables import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SYSTEM = "Write questions and answers from the passage."
MODEL, PER_CHUNK, SEED = "writer-1", 3, 42
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
STOP_ALL = "[" + ", ".join(f"'{w}'" for w in [*T.STOPWORDS, *T.DOMAIN_WORDS]) + "]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g'))"


def words_sql(x: str, stop: str = STOP, clean: str | None = None) -> str:
    return f"list_distinct(list_filter(string_split({clean or norm_sql(x)}, ' '), lambda w: w <> '' AND NOT list_contains({stop}, w)))"


def spaced_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g')"


# -- vectors --------------------------------------------------------------------------------------


def hits(spark: SparkSession, sf_dir: str, k: int = 11) -> DataFrame:
    return retrieval.top_k(derive.index(spark, sf_dir), derive.probes(spark, sf_dir), k)


@query(f"WITH {TOP_SQL} SELECT query_id, rank, score, chunk_id FROM hits WHERE rank <= 5")
def topk_search(spark, sf_dir):
    return hits(spark, sf_dir, 5).select("query_id", "rank", "score", "chunk_id")


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS best, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS best_score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_score DESC, best) AS k FROM s)
SELECT query_id, best, best_score, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS own_score, best = query_id AS is_self FROM r JOIN embeddings e ON e.vec_id = query_id WHERE k = 1""")
def self_retrieval_probe(spark, sf_dir):
    index = derive.index(spark, sf_dir)
    return retrieval.self_probe(index, index.where("chunk_id % 100 = 0"))


@query("""SELECT count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) FILTER (embedding IS NULL) AS null_vectors, count(*) FILTER (len(embedding) <> (SELECT max(len(embedding)) FROM embeddings)) AS other_dim,
count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-3) AS not_unit FROM embeddings""")
def index_verify(spark, sf_dir):
    return retrieval.verify_index(derive.index(spark, sf_dir))


@query("""WITH f AS (SELECT embedding AS v0, vec_id AS k0 FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v0 AS DOUBLE[])) AS sim FROM embeddings, f WHERE vec_id <> k0)
SELECT count(*) FILTER (sim > 0.9999) AS near_first, round(max(sim), 6) AS max_sim FROM s""")
def near_identical(spark, sf_dir):
    return retrieval.near_first(derive.index(spark, sf_dir))


RANKS_SQL = f"""{TOP_SQL},
firsts AS (SELECT query_id, min(rank - 1) AS rank FROM hits WHERE chunk_id <> query_id AND label = query_label AND rank > 1 GROUP BY 1),
ranks AS (SELECT vec_id AS query_id, label AS area, CAST(rank AS INTEGER) AS rank FROM embeddings LEFT JOIN firsts ON vec_id = query_id WHERE vec_id % 100 = 0)"""


def label_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, behind itself, of a query's first hit with its own label."""
    index = derive.index(spark, sf_dir).select("chunk_id", "label")
    probes = derive.probes(spark, sf_dir).select("query_id", "query_label")
    found = retrieval.with_text(hits(spark, sf_dir), index).join(probes, "query_id").where("chunk_id != query_id and label = query_label and rank > 1")
    first = found.groupBy("query_id").agg(F.min(F.col("rank") - 1).alias("rank"))
    return probes.join(first, "query_id", "left").select("query_id", F.col("query_label").alias("area"), "rank")


@query(f"""WITH {RANKS_SQL}
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found_frac, median(rank) AS median_rank,
round(10.0 / (SELECT count(*) FROM embeddings), 6) AS chance, round(round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) / (10.0 / (SELECT count(*) FROM embeddings)), 4) AS lift FROM ranks""")
def retrieval_metrics(spark, sf_dir):
    n = derive.index(spark, sf_dir).agg(F.count("*").alias("n_chunks"))
    out = retrieval.metrics(label_ranks(spark, sf_dir)).crossJoin(n)
    chance = F.lit(10) / F.col("n_chunks")
    return out.withColumn("chance", F.round(chance, 6)).withColumn("lift", F.round(F.col("hit_10") / chance, 4)).drop("n_chunks")


@query(f"WITH {RANKS_SQL} SELECT area, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5, count(*) AS n FROM ranks GROUP BY area")
def metrics_by_area(spark, sf_dir):
    return retrieval.by_area(label_ranks(spark, sf_dir), F.col("area"))


@query(f"WITH {RANKS_SQL} SELECT query_id, area FROM ranks WHERE rank IS NULL")
def misses(spark, sf_dir):
    return label_ranks(spark, sf_dir).where("rank is null").select("query_id", "area")


@query(f"""WITH {TOP_SQL},
b AS (SELECT query_id, rank, '[' || rank || '] ' || coalesce(source, '') || chr(10) || coalesce(text, '') AS block FROM hits LEFT JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
SELECT query_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_blocks FROM u WHERE used <= 6000 OR rank = 1 GROUP BY query_id""")
def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("breadcrumb"), "text")
    return retrieval.contexts(retrieval.with_text(hits(spark, sf_dir, 5), docs)).select("query_id", "context", "n_blocks")


# -- questions and answers ------------------------------------------------------------------------


@query(f"""WITH {QA_SQL} SELECT qa_id, CASE WHEN content <> '' AND area < 5 THEN 'Documentation excerpts:' || chr(10) || chr(10) || content || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || question ELSE question END AS user_message,
CASE WHEN content <> '' AND area < 5 THEN '{retrieval.GROUNDED}' ELSE '{retrieval.PLAIN}' END AS system_message FROM qa""")
def chat_messages(spark, sf_dir):
    pairs = derive.qa(spark, sf_dir)
    m = retrieval.messages(F.col("question"), F.when(F.col("area") < 5, F.col("content")))
    return pairs.withColumn("m", m).select("qa_id", F.col("m")[1]["content"].alias("user_message"), F.col("m")[0]["content"].alias("system_message"))


@query("""SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS system, min_by(text, turn) FILTER (role = 'user') AS "user", min_by(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id""")
def ablation_pivot(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    return retrieval.pivot_answers(first, "conv_id", "role", ["system", "user", "assistant"], "text")


@query(f"""WITH {QA_SQL}, w AS (SELECT qa_id, {norm_sql('question')} AS norm, {words_sql('question')} AS q, {words_sql('answer')} AS a, {words_sql('', STOP_ALL, spaced_sql('question'))} AS qs FROM qa)
SELECT qa_id, norm, len(q) AS q_words, len(a) AS a_words, len(qs) AS spaced_words, round(CASE WHEN len(list_distinct(list_concat(q, a))) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) END, 6) AS jaccard FROM w""")
def normalize_words(spark, sf_dir):
    q, a = T.content_words(F.col("question")), T.content_words(F.col("answer"))
    spaced = T.content_words(F.col("question"), [*T.STOPWORDS, *T.DOMAIN_WORDS], glue=False)
    return derive.qa(spark, sf_dir).select("qa_id", T.normalize(F.col("question")).alias("norm"), F.size(q).cast("long").alias("q_words"), F.size(a).cast("long").alias("a_words"), F.size(spaced).cast("long").alias("spaced_words"), F.round(T.jaccard(q, a), 6).alias("jaccard"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.gate(derive.qa(spark, sf_dir), ["doc_id", "item_idx"], key="doc_id")


def _contains(column: str, phrases: list[str]) -> str:
    return " OR ".join(f"contains(lower({column}), '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases)


BANNED_SQL = " ".join(f"WHEN contains(lower(question), '{p}') THEN 'meta_reference:{p}'" for p in qa.BANNED)


def valid_sql(rows: str) -> str:
    """Table v: the rows with the first reason to reject them."""
    return f"""w AS (SELECT *, list_filter(string_split({norm_sql('answer')}, ' '), lambda x: x <> '') AS aw, ' ' || array_to_string(list_filter(string_split({norm_sql('content')}, ' '), lambda x: x <> ''), ' ') || ' ' AS cw FROM {rows}),
v AS (SELECT qa_id, doc_id, gold_chunk_id, item_idx, question, answer, CASE WHEN length(question) < 15 THEN 'question_too_short' WHEN length(question) > 400 THEN 'question_too_long' WHEN NOT ends_with(question, '?') THEN 'question_not_a_question'
  WHEN length(answer) < 30 THEN 'answer_too_short' {BANNED_SQL} WHEN {_contains('answer', qa.SOURCED)} THEN 'answer_references_source' WHEN {_contains('answer', qa.REFUSED)} THEN 'answer_is_refusal'
  WHEN len(aw) = 0 OR len(list_filter(range(1, len(aw) - (6 * len(aw)) // 10 + 1), lambda i: contains(cw, ' ' || array_to_string(aw[i:i + (6 * len(aw)) // 10], ' ') || ' '))) > 0 THEN 'answer_is_extraction' END AS reason FROM w)"""


VALID_SQL = f"{QA_SQL},\n{valid_sql('qa')}"
GATE_SQL = f"""{VALID_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY {norm_sql('question')} ORDER BY doc_id, item_idx) AS k FROM v WHERE reason IS NULL)"""


def fold_sql(rows: str, key: str = "doc_id") -> str:
    """Tables o and r: whether an answer is like one kept before it in its document, or other key."""
    return f"""o AS (SELECT qa_id, {key} AS doc_id, row_number() OVER (PARTITION BY {key} ORDER BY item_idx) AS nth, {words_sql('answer')} AS words FROM {rows}),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[][]) AS kept, CAST(NULL AS VARCHAR) AS qa_id, false AS redundant FROM o WHERE nth = 1
UNION ALL SELECT o.doc_id, o.nth, CASE WHEN len(o.words) = 0 OR t.hit THEN r.kept ELSE list_append(r.kept, o.words) END, o.qa_id, t.hit FROM r JOIN o ON o.doc_id = r.doc_id AND o.nth = r.nth + 1,
LATERAL (SELECT len(list_filter(r.kept, lambda k: len(o.words) > 0 AND len(list_intersect(k, o.words)) / len(list_distinct(list_concat(k, o.words))) >= 0.45)) > 0 AS hit) t)"""


GATED_SQL = f"""WITH RECURSIVE {GATE_SQL}, {fold_sql('(SELECT * FROM n WHERE k = 1)')},
g AS (SELECT qa_id, doc_id, gold_chunk_id, item_idx, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT qa_id, doc_id, gold_chunk_id, item_idx, 'duplicate_question' FROM n WHERE k > 1
UNION ALL SELECT n.qa_id, n.doc_id, gold_chunk_id, item_idx, CASE WHEN redundant THEN 'redundant_answer_same_chunk' END FROM n JOIN r ON r.qa_id = n.qa_id WHERE k = 1)"""


@query(f"WITH {VALID_SQL} SELECT qa_id, reason FROM v")
def qa_validate(spark, sf_dir):
    return qa.validate(derive.qa(spark, sf_dir)).select("qa_id", "reason")


@query(f"WITH {GATE_SQL} SELECT qa_id, k = 1 AS is_first FROM n")
def question_dedup(spark, sf_dir):
    return qa.first_questions(qa.validate(derive.qa(spark, sf_dir)), ["doc_id", "item_idx"], F.col("reason").isNull()).select("qa_id", F.col("first").alias("is_first"))


@query(f"WITH RECURSIVE {QA_SQL}, {fold_sql('qa')} SELECT qa_id, redundant FROM r WHERE nth > 0")
def redundant_answers(spark, sf_dir):
    return qa.redundant(derive.qa(spark, sf_dir), "doc_id", "item_idx").select("qa_id", "redundant")


@query(f"{GATED_SQL} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1")
def reject_report(spark, sf_dir):
    return qa.reject_report(gated(spark, sf_dir))


@query(f"""{GATED_SQL} SELECT count(*) AS attempted, count(*) FILTER (reason IS NULL) AS accepted, CAST(0 AS BIGINT) AS unsuitable, CAST(0 AS BIGINT) AS unparseable,
count(DISTINCT doc_id) FILTER (reason IS NULL) AS docs, count(DISTINCT gold_chunk_id) FILTER (reason IS NULL) AS chunks FROM g""")
def qa_coverage(spark, sf_dir):
    return qa.coverage(gated(spark, sf_dir))


@query(f"{GATED_SQL} SELECT qa_id, doc_id, item_idx, row_number() OVER (ORDER BY doc_id, item_idx) - 1 AS ordinal FROM g WHERE reason IS NULL")
def qa_numbering(spark, sf_dir):
    """Accepted pairs with their global ordinal."""
    ok = gated(spark, sf_dir).where("reason is null").select("qa_id", "doc_id", "item_idx")
    return qa.numbered(ok, ["doc_id", "item_idx"], "ordinal")


@query(f"""WITH {QA_SQL}, o AS (SELECT qa_id, {words_sql('', STOP_ALL, spaced_sql('question'))} AS q, {words_sql('', STOP_ALL, spaced_sql("area || ' ' || answer"))} AS a, CASE WHEN answer = content THEN 1 END AS rank FROM qa),
p AS (SELECT CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(q) END AS overlap, CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END AS hit FROM o)
SELECT count(*) FILTER (overlap < 0.3) AS n_low, count(*) FILTER (overlap >= 0.5) AS n_high, round(avg(hit) FILTER (overlap < 0.3), 6) AS hit_low, round(avg(hit) FILTER (overlap >= 0.5), 6) AS hit_high, round(avg(hit) FILTER (overlap >= 0.5) - avg(hit) FILTER (overlap < 0.3), 6) AS gap FROM p""")
def overlap_buckets(spark, sf_dir):
    pairs = derive.qa(spark, sf_dir)
    own = F.concat_ws(" ", F.col("area").cast("string"), F.col("answer"))
    ranks = pairs.select(retrieval.question_overlap(F.col("question"), own).alias("overlap"), F.when(F.col("answer") == F.col("content"), 1).alias("rank"))
    return retrieval.overlap_gap(ranks)


@query(f"WITH {QA_SQL} SELECT qa_id, doc_id FROM qa WHERE gold_chunk_id NOT IN (SELECT gold_chunk_id FROM qa WHERE contains(content, ', '))")
def orphan_questions(spark, sf_dir):
    """Questions whose gold chunk is not in an index of the chunks with a comma."""
    pairs = derive.qa(spark, sf_dir)
    return retrieval.orphans(pairs, pairs.where(F.contains("content", F.lit(", "))), "gold_chunk_id", "gold_chunk_id").select("qa_id", "doc_id")


# -- sampling and requests ------------------------------------------------------------------------


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as chunks of their conversation; those with a comma count as code-bearing."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.select(F.col("conv_id").alias("doc_id"), F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.contains("text", F.lit(", ")).alias("has_code"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("breadcrumb"), F.col("text").alias("content"))


SOURCE_SQL = """src AS (SELECT conv_id AS doc_id, conv_id || '::' || turn AS chunk_id, contains(text, ', ') AS has_code, 'conv ' || conv_id AS breadcrumb, text AS content FROM conversations WHERE role = 'assistant')"""
SAMPLE_SQL = f"""{SOURCE_SQL},
s1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY has_code DESC, md5('{SEED}|' || chunk_id), chunk_id) AS nth FROM src),
s2 AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED + 1}|' || chunk_id), chunk_id) - 1 AS sample_ord FROM s1 WHERE nth <= 2)"""


@query(f"WITH {SAMPLE_SQL} SELECT chunk_id, doc_id, sample_ord FROM s2 WHERE sample_ord < 100")
def stratified_sample(spark, sf_dir):
    return qa.sample_chunks(source_chunks(spark, sf_dir), 100, 2, SEED).select("chunk_id", "doc_id", "sample_ord")


KEY_SQL = f"substr(sha256(chunk_id || '|{MODEL}|{PER_CHUNK}'), 1, 20)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.requests(source_chunks(spark, sf_dir).withColumn("sample_ord", F.lit(0).cast("long")), SYSTEM, MODEL, PER_CHUNK)


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache_key, raw: a response to each assistant turn that follows a user turn, with three pairs: the turns'
    own, one more question with the same answer, and the first question in capitals."""
    pairs = derive.qa(spark, sf_dir).withColumn("chunk_id", F.concat_ws("::", F.col("doc_id").cast("string"), (F.col("item_idx") + 1).cast("string")))
    item = lambda q: F.struct(q.alias("question"), F.col("answer"))
    items = F.array(item(F.col("question")), item(F.concat(F.lit("In short: "), "question")), item(F.upper("question")))
    raw = F.to_json(F.struct((F.col("area") != 6).alias("suitable"), items.alias("questions")))
    raw = F.when(F.col("area") == 4, F.expr("substring(question, 1, 9)")).when(F.col("area") == 2, F.concat(F.lit("Here: "), raw)).otherwise(raw)
    return pairs.select(qa.cache_key(F.col("chunk_id"), MODEL, PER_CHUNK).alias("cache_key"), raw.alias("raw"))


ITEMS_SQL = f"""{QA_SQL}, {SOURCE_SQL},
s1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY has_code DESC, md5('{SEED}|' || chunk_id), chunk_id) AS nth FROM src),
s2 AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED + 1}|' || chunk_id), chunk_id) - 1 AS sample_ord FROM s1 WHERE nth <= 3),
it AS (SELECT s2.chunk_id || '::' || k AS qa_id, s2.doc_id, s2.chunk_id AS gold_chunk_id, CAST(k AS INTEGER) AS item_idx, sample_ord, breadcrumb, s2.content,
  CASE k WHEN 0 THEN question WHEN 1 THEN 'In short: ' || question ELSE upper(question) END AS question, answer
  FROM s2 JOIN qa ON s2.chunk_id = qa.doc_id || '::' || (qa.item_idx + 1), LATERAL (SELECT unnest(range(3)) AS k) i WHERE area NOT IN (4, 6)),
{valid_sql('it')},
n AS (SELECT v.*, sample_ord, row_number() OVER (PARTITION BY {norm_sql('v.question')} ORDER BY sample_ord, v.item_idx) AS k FROM v JOIN it USING (qa_id) WHERE reason IS NULL), {fold_sql('(SELECT * FROM n WHERE k = 1)', 'gold_chunk_id')},
ok AS (SELECT n.* FROM n JOIN r ON r.qa_id = n.qa_id WHERE k = 1 AND NOT redundant)"""


@query(f"""WITH RECURSIVE {ITEMS_SQL} SELECT ok.gold_chunk_id || '::q' || (row_number() OVER (ORDER BY ok.sample_ord, ok.item_idx) - 1) AS qa_id, trim(ok.question) AS question, trim(ok.answer) AS answer, ok.gold_chunk_id, CAST(ok.doc_id AS VARCHAR) AS doc_id, it.breadcrumb, '{derive.BASE}' || ok.doc_id || '.html' AS url, 'none' AS provider, '{MODEL}' AS model FROM ok JOIN it USING (qa_id)""")
def qa_pairs(spark, sf_dir):
    """From the sample over requests, responses and gates to the table of pairs, in sample order."""
    chunks = source_chunks(spark, sf_dir).withColumn("url", F.concat(F.lit(derive.BASE), F.col("doc_id").cast("string"), F.lit(".html")))
    sample = qa.sample_chunks(chunks, None, 3, SEED)
    rows = qa.generated(qa.requests(sample, SYSTEM, MODEL, PER_CHUNK), several(spark, sf_dir), chunks)
    return qa.qa_pairs(qa.gate(rows, ["sample_ord", "item_idx"]), "none")


@query(f"""WITH {SOURCE_SQL}, q AS (SELECT {KEY_SQL} AS cache_key, chunk_id, 'Documentation section: ' || breadcrumb || chr(10) || chr(10) || '--- PASSAGE START ---' || chr(10) || content || chr(10) || '--- PASSAGE END ---' || chr(10) || chr(10) || 'Write {PER_CHUNK} question-answer pairs following the rules. JSON only.' AS prompt FROM src)
SELECT cache_key, chunk_id, md5(prompt) AS prompt_md5 FROM q WHERE substr(cache_key, 1, 1) NOT IN ('0', '1', '2', '3')""")
def resume_requests(spark, sf_dir):
    requests = asked(spark, sf_dir)
    cached = requests.where(F.substring("cache_key", 1, 1).isin("0", "1", "2", "3")).select("cache_key", F.lit("{}").alias("raw"))
    return qa.unanswered(requests, cached).select("cache_key", "chunk_id", F.md5("user").alias("prompt_md5"))


def responses(pairs: DataFrame) -> Column:
    """Responses built from the pairs, plain and in the deviations that occur."""
    item = F.to_json(F.struct("question", F.when(F.col("area") != 7, F.col("answer")).alias("answer")), {"ignoreNullFields": "false"})
    whole = F.concat(F.lit('{"suitable": '), F.when(F.col("area") == 6, "false").otherwise("true"), F.lit(', "questions": ['), item, F.lit("]}"))
    bare = F.concat(F.lit('{"questions": ['), item, F.lit("]}"))
    return (
        F.when(F.col("area") == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(F.col("area") == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" Done.")))
        .when(F.col("area") == 3, bare).when(F.col("area") == 4, F.expr("substring(question, 1, 9)")).when(F.col("area") == 5, F.lit("[]")).otherwise(whole)
    )


@query(f"""WITH {QA_SQL} SELECT qa_id, CASE WHEN area IN (4, 5) THEN NULL ELSE area <> 6 END AS suitable, CASE WHEN area IN (4, 5) THEN NULL ELSE question END AS question, CASE WHEN area IN (4, 5) THEN NULL WHEN area = 7 THEN 'None' ELSE answer END AS answer FROM qa""")
def parse_responses(spark, sf_dir):
    """Responses parsed back."""
    pairs = derive.qa(spark, sf_dir)
    got = qa.parse_responses(pairs.select("qa_id", responses(pairs).alias("raw")))
    first = F.get("parsed.questions", F.lit(0))
    return got.select("qa_id", F.col("parsed.suitable").alias("suitable"), first["question"].alias("question"), first["answer"].alias("answer"))


@query(f"""WITH {QA_SQL} SELECT gold_chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN area IN (4, 5) THEN 'unparseable_response' WHEN area = 6 THEN 'unsuitable_chunk' END AS outcome, CASE WHEN area NOT IN (4, 5, 6) THEN md5(question) END AS question_md5, md5(content) AS content_md5 FROM qa""")
def generated_pairs(spark, sf_dir):
    """Requests answered, parsed and joined with their source chunks."""
    pairs = derive.qa(spark, sf_dir)
    chunks = pairs.select(F.col("gold_chunk_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("crumb").alias("breadcrumb"), "content")
    own = qa.cache_key(F.col("gold_chunk_id"), MODEL, PER_CHUNK)
    asked_ = qa.requests(chunks.withColumn("sample_ord", F.lit(0).cast("long")), SYSTEM, MODEL, PER_CHUNK)
    rows = qa.generated(asked_, pairs.select(own.alias("cache_key"), responses(pairs).alias("raw")), chunks)
    return rows.select("gold_chunk_id", "doc_id", "outcome", F.md5("question").alias("question_md5"), F.md5("content").alias("content_md5"))


@query(f"""WITH {SAMPLE_SQL}, s AS (SELECT * FROM s2 WHERE sample_ord < 100) SELECT (SELECT count(*) FROM src) AS corpus_chunks, (SELECT count(DISTINCT doc_id) FROM src) AS corpus_docs, (SELECT count(*) FROM s) AS sample_chunks, (SELECT count(DISTINCT doc_id) FROM s) AS sample_docs, (SELECT count(*) FROM s) * {PER_CHUNK} AS target_pairs""")
def sample_report(spark, sf_dir):
    chunks = source_chunks(spark, sf_dir)
    return qa.sample_report(chunks, qa.sample_chunks(chunks, 100, 2, SEED), PER_CHUNK)


# -- splitting ------------------------------------------------------------------------------------

SPLIT_SQL = f"""{QA_SQL},
d AS (SELECT area, doc_id, count(*) AS n, md5('{SEED}|' || doc_id) AS draw FROM qa GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY draw, doc_id) AS nth, sum(n) OVER (PARTITION BY area) * 0.2::DOUBLE AS target FROM d),
r AS (SELECT area, CAST(0 AS BIGINT) AS nth, CAST(0 AS HUGEINT) AS taken, CAST(NULL AS BIGINT) AS doc_id, false AS val FROM o WHERE nth = 1
UNION ALL SELECT o.area, o.nth, CASE WHEN t.take THEN r.taken + o.n ELSE r.taken END, o.doc_id, t.take FROM r JOIN o ON o.area = r.area AND o.nth = r.nth + 1,
LATERAL (SELECT NOT (r.taken >= o.target OR (r.taken > 0 AND r.taken + o.n > o.target * 2)) AS take) t),
s AS (SELECT qa.*, CASE WHEN r.val THEN 'val' ELSE 'train' END AS split FROM qa JOIN r ON qa.doc_id = r.doc_id)"""


def divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(splitting.split(derive.qa(spark, sf_dir), 0.2, SEED, F.col("doc_id") % 10), "split")


@query(f"WITH RECURSIVE {SPLIT_SQL} SELECT qa_id, split FROM s")
def split_by_document(spark, sf_dir):
    return divided(spark, sf_dir).select("qa_id", "split")


@query(f"""WITH RECURSIVE {SPLIT_SQL}, l AS (SELECT split, length(answer) AS len, row_number() OVER (PARTITION BY split ORDER BY length(answer)) - 1 AS i, count(*) OVER (PARTITION BY split) AS c FROM s),
m AS (SELECT split, len AS median_answer FROM l WHERE i = c // 2), a AS (SELECT split, area, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, CAST(area AS VARCHAR)) AS k FROM a),
t AS (SELECT split, string_agg(area || ':' || n, ',' ORDER BY k) AS top_areas FROM k WHERE k <= 4 GROUP BY 1)
SELECT s.split, count(*) AS pairs, count(DISTINCT doc_id) AS docs, round(avg(CASE WHEN contains(answer, '```') THEN 1.0 ELSE 0.0 END), 6) AS with_code, CAST(max(length(answer)) AS INTEGER) AS longest, CAST(any_value(median_answer) AS INTEGER) AS median_answer, any_value(top_areas) AS top_areas, round(count(*) / (SELECT count(*) FROM s), 6) AS share
FROM s JOIN m ON m.split = s.split JOIN t ON t.split = s.split GROUP BY s.split""")
def split_describe(spark, sf_dir):
    return splitting.describe(divided(spark, sf_dir), F.col("area"))


COVER_SQL = f"""{SPLIT_SQL}, e AS (SELECT split, qa_id, unnest({words_sql('question', STOP_ALL)}) AS word FROM s), tv AS (SELECT DISTINCT word FROM e WHERE split = 'train'),
c AS (SELECT qa_id, avg(CASE WHEN tv.word IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM e LEFT JOIN tv ON tv.word = e.word WHERE split = 'val' GROUP BY 1)"""


@query(f"""WITH RECURSIVE {COVER_SQL} SELECT (SELECT count(*) FROM (SELECT doc_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_docs, (SELECT count(*) FROM (SELECT gold_chunk_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_chunks,
(SELECT count(*) FROM (SELECT {norm_sql('question')} AS k FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS shared_questions, coalesce((SELECT round(median(coverage), 6) FROM c), 0.0) AS median_vocab_coverage, coalesce((SELECT round(avg(CASE WHEN coverage > 0.9 THEN 1.0 ELSE 0.0 END), 6) FROM c), 0.0) AS high_coverage_frac""")
def leakage_report(spark, sf_dir):
    return splitting.leakage(divided(spark, sf_dir))


@query(f"WITH RECURSIVE {COVER_SQL} SELECT qa_id, round(coverage, 6) AS coverage FROM c")
def vocab_coverage(spark, sf_dir):
    return splitting.coverages(divided(spark, sf_dir)).select("qa_id", F.round("coverage", 6).alias("coverage"))


# -- documents ------------------------------------------------------------------------------------


@query(f"""WITH {SECTIONS_SQL} SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_sections, count(*) FILTER (contains(text, '```')) AS with_code, sum(length(text)) AS total_chars, round(avg(length(text)), 6) AS mean_chars, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_files FROM sections""")
def section_stats(spark, sf_dir):
    return chunking.section_stats(derive.sections(spark, sf_dir), table(spark, sf_dir, "documents")).withColumn("mean_chars", F.round("mean_chars", 6))


LINES_SQL = f"""{SECTIONS_SQL}, l AS (SELECT doc_id, section_seq, coalesce(breadcrumb, '') || ' > ' || (section_seq // 3) || ' > ' || section_seq AS breadcrumb, url, text, length(text) AS n, length(text) < {4 * chunking.SMALL} AS short FROM sections)"""


@query(f"""WITH RECURSIVE {LINES_SQL},
f AS (SELECT doc_id, section_seq, section_seq AS head, CASE WHEN short THEN n ELSE 0 END AS chars, short AS open FROM l WHERE section_seq = 0
  UNION ALL SELECT l.doc_id, l.section_seq, CASE WHEN l.short AND f.open THEN f.head ELSE l.section_seq END, t.chars, l.short AND t.chars < {12 * chunking.SMALL} FROM f JOIN l ON l.doc_id = f.doc_id AND l.section_seq = f.section_seq + 1,
  LATERAL (SELECT CASE WHEN l.short AND f.open THEN f.chars + 2 + l.n WHEN l.short THEN l.n ELSE 0 END AS chars) t),
g AS (SELECT f.doc_id, head, count(*) AS merged_from, string_agg(text, chr(10) || chr(10) ORDER BY l.section_seq) AS text, min(l.section_seq // 3) = max(l.section_seq // 3) AS one_part FROM f JOIN l ON l.doc_id = f.doc_id AND l.section_seq = f.section_seq GROUP BY 1, 2)
SELECT g.doc_id, head AS section_seq, CAST(merged_from AS INTEGER) AS merged_from, CASE WHEN merged_from = 1 THEN l.breadcrumb WHEN one_part THEN regexp_replace(l.breadcrumb, ' > [0-9]+$', '') ELSE regexp_replace(l.breadcrumb, ' > [0-9]+ > [0-9]+$', '') END AS breadcrumb, l.url, md5(g.text) AS text_md5
FROM g JOIN l ON l.doc_id = g.doc_id AND l.section_seq = g.head""")
def merge_small(spark, sf_dir):
    """Lines as sections under a breadcrumb of three levels; short neighbours joined."""
    part = F.concat(F.coalesce("breadcrumb", F.lit("")), F.lit(" > "), F.floor(F.col("section_seq") / 3).cast("string"), F.lit(" > "), F.col("section_seq").cast("string"))
    rows = chunking.merged(derive.sections(spark, sf_dir).withColumn("breadcrumb", part))
    return rows.select("doc_id", "section_seq", "merged_from", "breadcrumb", "url", F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {SECTIONS_SQL}, u AS (SELECT doc_id, max({chunking.PACK_LIMIT} - (greatest(1, length(coalesce(breadcrumb, '')) // 4) + 2)) AS budget, list(greatest(1, length(text) // 4) ORDER BY section_seq) AS sizes, list(contains(text, ', ') ORDER BY section_seq) AS code FROM sections GROUP BY doc_id),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS closed, CAST(NULL AS BIGINT) AS closed_first FROM u
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN t.full THEN i - t.tail ELSE first END, CASE WHEN t.full THEN coalesce(list_sum(sizes[i - t.tail + 1:i]), 0) ELSE size END + sizes[i + 1], CASE WHEN t.full THEN i - 1 END, CASE WHEN t.full THEN first END
  FROM f JOIN u USING (doc_id), LATERAL (SELECT i > first AND size + sizes[i + 1] > budget AS full, list_max(list_filter(range(0, i - first + 1), lambda k: coalesce(list_sum(sizes[i - k + 1:i]), 0) <= {chunking.OVERLAP} AND NOT list_contains(code[i - k + 1:i], true))) AS tail) t WHERE i < len(sizes)),
g AS (SELECT doc_id, closed_first AS first_unit, closed AS last_unit FROM f WHERE closed IS NOT NULL UNION ALL SELECT doc_id, first, len(sizes) - 1 FROM f JOIN u USING (doc_id) WHERE i = len(sizes))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY last_unit) - 1 AS INTEGER) AS piece, CAST(first_unit AS INTEGER) AS first_unit, CAST(last_unit AS INTEGER) AS last_unit, CAST(list_sum(sizes[first_unit + 1:last_unit + 1]) AS BIGINT) AS tokens FROM g JOIN u USING (doc_id)""")
def pack_chunks(spark, sf_dir):
    """Lines as units of their document, those with a comma standing for code, packed with overlap."""
    unit = F.struct("section_seq", T.tokens(F.col("text")).cast("long").alias("size"), F.contains("text", F.lit(", ")).alias("code"))
    docs = derive.sections(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("units"), F.max(T.tokens(F.coalesce("breadcrumb", F.lit("")))).alias("crumb"))
    groups = docs.select("doc_id", "units", F.posexplode(chunking.packed("units", F.lit(chunking.PACK_LIMIT) - (F.col("crumb") + 2))).alias("piece", "g"))
    held = F.slice("units", F.col("g.first") + 1, F.col("g.last") - F.col("g.first") + 1)
    return groups.select("doc_id", "piece", F.col("g.first").alias("first_unit"), F.col("g.last").alias("last_unit"), F.aggregate(held, F.lit(0).cast("long"), lambda s, u: s + u["size"]).alias("tokens"))


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk(derive.sections(spark, sf_dir)).select("chunk_id", "breadcrumb", "url", "n_tokens", "has_code", "code_split", "merged_from", F.md5("text").alias("text_md5"))


@query()
def chunk_stats(spark, sf_dir):
    rows = derive.sections(spark, sf_dir)
    return chunking.stats(chunking.cut(rows), rows)


@query(f"""WITH {SECTIONS_SQL}, h AS (SELECT greatest(1, length(text) // 4) AS n_tokens FROM sections), o AS (SELECT n_tokens, row_number() OVER (ORDER BY n_tokens) - 1 AS i, count(*) OVER () AS n FROM h)
SELECT CAST(n_tokens AS INTEGER) AS p95_tokens FROM o WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def token_percentile(spark, sf_dir):
    rows = derive.sections(spark, sf_dir).select(T.tokens(F.col("text")).alias("p95_tokens"))
    return chunking.order_statistic(rows, "p95_tokens", lambda n: F.least(F.floor(n * 0.95), n - 1))


@query(f"""WITH {SECTIONS_SQL}, k AS (SELECT doc_id, section_seq, greatest(1, length(text) // 4) AS n_tokens FROM sections)
SELECT doc_id, section_seq, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_seq) - 1 AS INTEGER) AS chunk_seq, doc_id || '::' || (row_number() OVER (PARTITION BY doc_id ORDER BY section_seq) - 1) AS chunk_id FROM k WHERE n_tokens >= 48""")
def renumber_chunks(spark, sf_dir):
    rows = derive.sections(spark, sf_dir).select("doc_id", "section_seq", F.lit(0).alias("piece_seq"), T.tokens(F.col("text")).alias("n_tokens")).where("n_tokens >= 48")
    return chunking.renumber(rows).select("doc_id", "section_seq", "n_tokens", "chunk_seq", "chunk_id")


@query(r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(parts) AS n_sentences, md5(parts[1]) AS first_md5, md5(parts[-1]) AS last_md5 FROM s""")
def sentence_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("n_sentences"), F.md5(F.element_at("parts", 1)).alias("first_md5"), F.md5(F.element_at("parts", -1)).alias("last_md5"))


@query()
def clean_inline(spark, sf_dir):
    """Words of the documents in inline markup, cleaned."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    marked = F.regexp_replace("text", r"(?U)\b(\w+)ing\b", r"**$1ing**")
    return docs.select("doc_id", F.md5(T.clean_inline(F.regexp_replace(marked, r"(?U)\b(\w+)ed\b", r":doc:`$1ed <path>`"))).alias("clean_md5"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_texts FROM documents")
def distinct_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("text").alias("n_texts"))


PATH_SQL = r"""p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), q AS (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN replace(path, '/', '\') ELSE path END AS path FROM p)"""


@query(rf"""WITH {PATH_SQL} SELECT page_id, regexp_extract(path, '^[^\\/]*') AS area, 'https://docs.example.org/' || regexp_replace(replace(path, '\', '/'), '([^/])\.[^./]+$', '\1') || '.html' AS page_url FROM q""")
def page_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    own = F.when(F.col("page_id") % 2 == 1, F.translate(path, "/", "\\")).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", own.alias("path")).select("page_id", T.top_dir(F.col("path")).alias("area"), T.page_url(F.col("path"), derive.BASE).alias("page_url"))


@query(r"SELECT regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\.[^./]+)$', 1) AS ext, count(*) AS files, round(sum(strlen(html)) / 1e6, 6) AS mb FROM pages GROUP BY 1")
def corpus_inventory(spark, sf_dir):
    ext = F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), r"(\.[^./]+)$", 1)
    return table(spark, sf_dir, "pages").groupBy(ext.alias("ext")).agg(F.count("*").alias("files"), F.round(F.sum(F.octet_length("html")) / 1e6, 6).alias("mb"))


@query()
def parse_rst(spark, sf_dir):
    """The documents as marked-up files, a heading before each line, parsed to sections."""
    from tidewright.sources import rst

    body = F.regexp_replace("text", "\n", "\n\nPart\n----\n\n")
    head = F.concat("source", F.lit("\n========\n\n.. note:: generated\n\n   body\n\n"), body)
    raw = table(spark, sf_dir, "documents").where("text is not null").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rst")).alias("doc_id"), head.cast("binary").alias("content"))
    return rst.parse_documents(raw, derive.BASE).select("doc_id", "section_seq", "title", "breadcrumb", "level", "n_chars", "has_code", "url", "error", F.md5("text").alias("text_md5"))


# The lines of a document with titles, code and titles in code among them, by their number.
MARKED = {0: ("Part {i}\n========\n", ""), 2: ("Step {i}\n----------\n", ""), 3: ("```\nNot {i}\n--------\n", ""), 4: ("", "\n```"), 5: ("Note {i}\n~~~~~~~~\n", ""), 6: ("Tick {i}\n````````\n", ""), 7: ("Sub {i}\n........\n\n\n", "")}
WHITE_SQL = "'" + outline.WHITE + "'"


def _marked_sql() -> str:
    text = lambda t: "'" + t.replace("{i}", "' || i || '").replace("\n", "' || chr(10) || '") + "'"
    return "CASE i % 8 " + " ".join(f"WHEN {k} THEN {text(a)} || parts[i + 1] || {text(b)}" for k, (a, b) in MARKED.items()) + " ELSE parts[i + 1] END"


OUTLINE_SQL = f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, string_agg({_marked_sql()}, chr(10) ORDER BY i) AS text FROM p GROUP BY 1),
s AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM f),
l AS (SELECT doc_id, CAST(n AS BIGINT) AS n, parts[n + 1] AS line FROM (SELECT *, unnest(range(CASE WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END)) AS n FROM s)),
u AS (SELECT *, starts_with(line, '```') AS edge, rtrim(lead(line) OVER w, {WHITE_SQL}) AS s, rtrim(line, {WHITE_SQL}) AS name FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
c AS (SELECT doc_id, n, line, edge, NOT edge AND coalesce(length(s) >= 3 AND contains('{outline.UNDERLINES.replace("'", "''")}', left(s, 1)) AND replace(s, left(s, 1), '') = '' AND name <> '' AND length(s) >= length(name) - 2, false) AS cand FROM u),
m AS (SELECT *, cand AND (n - coalesce(max(n) FILTER (NOT cand) OVER w, -1)) % 2 = 1 AS may FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
e AS (SELECT *, edge AND coalesce(lag(may) OVER w, false) AS soft FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
k AS (SELECT *, count(*) FILTER (edge AND NOT soft) OVER w AS edges FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT *, may AND (edges - coalesce(max(edges) FILTER (soft) OVER w, 0)) % 2 = 0 AS heading FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT *, coalesce(lag(heading) OVER w, false) AS under, count(*) FILTER (heading) OVER w AS nth, coalesce(line = '' AND lag(line) OVER w = '', false) AS again FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT doc_id, nth, max(trim(line, {WHITE_SQL})) FILTER (heading) AS title, max(left(line, 1)) FILTER (under) AS mark,
  trim(coalesce(string_agg(rtrim(line, {WHITE_SQL}), chr(10) ORDER BY n) FILTER (NOT heading AND NOT under AND NOT again), ''), {WHITE_SQL}) AS text FROM r GROUP BY 1, 2),
g AS (SELECT doc_id, mark, row_number() OVER (PARTITION BY doc_id ORDER BY min(nth)) - 1 AS level FROM b WHERE mark IS NOT NULL GROUP BY doc_id, mark),
t AS (SELECT b.*, CAST(coalesce(level, 0) AS INTEGER) AS level FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND g.mark = b.mark),
d AS (SELECT *, nth - 1 + min(level - nth + 1) FILTER (nth > 0) OVER (PARTITION BY doc_id ORDER BY nth) AS deep FROM t),
a AS (SELECT *, concat_ws(' > ', {", ".join(f"CASE WHEN deep >= {i} THEN arg_max(title, nth) FILTER (deep = {i}) OVER w END" for i in range(len(outline.UNDERLINES)))}) AS crumbs FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY nth))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS INTEGER) AS section_seq, coalesce(title, CAST(doc_id AS VARCHAR)) AS title, CASE WHEN nth > 0 THEN crumbs ELSE CAST(doc_id AS VARCHAR) END AS breadcrumb,
level, CAST(length(text) AS INTEGER) AS n_chars, contains(text, '```') AS has_code, md5(text) AS text_md5 FROM a WHERE length(text) >= {outline.LEAST}"""


@query(OUTLINE_SQL)
def outline_sections(spark, sf_dir):
    """Sections of the documents by windows over lines, titles and code put among their lines."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    def put(line: Column, i: Column) -> Column:
        out = line
        for k, (a, b) in MARKED.items():
            out = F.when(i % 8 == k, F.concat(F.replace(F.lit(a), F.lit("{i}"), i.cast("string")), line, F.lit(b))).otherwise(out)
        return out

    text = F.array_join(F.transform(F.split("text", "\n"), put), "\n")
    sections = outline.outline(outline.file_lines(docs, text))
    return sections.select("doc_id", "section_seq", "title", "breadcrumb", "level", "n_chars", "has_code", F.md5("text").alias("text_md5"))


@query()
def embed_search(spark, sf_dir):
    """Questions against all gold chunks through the stand-in encoder: gold rank of each."""
    pairs = derive.qa(spark, sf_dir)
    chunks = retrieval.embed(pairs.select(F.col("gold_chunk_id").alias("chunk_id"), "content").distinct(), F.col("content"), retrieval.hashed_words())
    asked = retrieval.embed(pairs.select(F.col("qa_id").alias("query_id"), "answer"), F.col("answer"), retrieval.hashed_words())
    return retrieval.gold_ranks(pairs.select("qa_id", "gold_chunk_id"), retrieval.top_k(chunks, asked, 10))


# -- training rows --------------------------------------------------------------------------------

CODES = "list_transform(range(1, length({x}) + 1), lambda i: unicode(substr({x}, i, 1)))"
TRAIN_SQL = f"""{QA_SQL}, ids AS (SELECT qa_id, doc_id, item_idx, {CODES.format(x="p")} AS p, list_append({CODES.format(x="answer")}, 0) AS a FROM (SELECT *, 'system' || chr(10) || '{SYSTEM}' || chr(10) || 'user' || chr(10) || question || chr(10) || 'assistant' || chr(10) AS p FROM qa)),
ex AS (SELECT qa_id, doc_id, item_idx, list_concat(p, a)[1:1024] AS input_ids, list_concat(list_transform(p, lambda x: -100), a)[1:1024] AS labels FROM ids)"""


@query(f"""WITH {TRAIN_SQL} SELECT qa_id, len(input_ids) AS n, len(list_filter(labels, lambda x: x = -100)) AS masked, md5(array_to_string(input_ids, ',')) AS ids_md5, md5(array_to_string(labels, ',')) AS labels_md5 FROM ex""")
def train_labels(spark, sf_dir):
    ex = training.examples(derive.qa(spark, sf_dir), SYSTEM, 1024)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return ex.select("qa_id", F.size("input_ids").cast("long").alias("n"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"), text("input_ids").alias("ids_md5"), text("labels").alias("labels_md5"))


@query(f"""WITH {TRAIN_SQL}, g AS (SELECT *, row_number() OVER (ORDER BY doc_id, item_idx) - 1 AS global_idx FROM ex), b AS (SELECT *, global_idx // 8 AS batch_id, max(len(input_ids)) OVER (PARTITION BY global_idx // 8) AS most, count(*) OVER (PARTITION BY global_idx // 8) AS c FROM g)
SELECT global_idx, batch_id, most AS width, len(input_ids) AS attended, md5(array_to_string(list_concat(input_ids, list_transform(range(most - len(input_ids)), lambda x: 0)), ',')) AS ids_md5 FROM b WHERE c = 8""")
def pad_batches(spark, sf_dir):
    pairs = derive.qa(spark, sf_dir)
    ex = training.examples(pairs, SYSTEM, 1024).join(pairs.select("qa_id", "doc_id", "item_idx"), "qa_id")
    out = training.batches(qa.numbered(ex, ["doc_id", "item_idx"], "global_idx"), 8)
    text = F.md5(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ","))
    return out.select("global_idx", "batch_id", F.size("input_ids").cast("long").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("attended"), text.alias("ids_md5"))
