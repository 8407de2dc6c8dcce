"""One query for each operator on the test tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid import plans, sources, streaming
from corvid.functions import text as t
from corvid.functions import vectors as v
from corvid.operators import chat, hygiene, lineage, models, reports, retrieval, routing
from corvid.operators import evaluation as e

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, names)


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(names: str, rows: list[tuple]) -> str:
    """The rows as a SQL table."""
    cols = ", ".join(n.split()[0] for n in names.split(", "))
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({cols})"


SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
DUCK_WORDS = f"list_filter(string_split({SQUEEZE.format('text')}, ' '), lambda w: w <> '')"
DUCK_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


# Text functions --------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(k) AS n_tokens, len(list_distinct(k)) AS n_distinct FROM (SELECT doc_id, {DUCK_TOKENS.format('text')} AS k FROM documents)")
def text_tokens(spark, sf_dir):
    k = read(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(F.array_distinct("k")).cast("long").alias("n_distinct"))


@query(f"""WITH w AS (SELECT doc_id, {DUCK_WORDS} AS w FROM documents),
 p AS (SELECT doc_id, i AS no, list_slice(w, i * 300 + 1, i * 300 + 300) AS p FROM w, LATERAL (SELECT unnest(range(0, (len(w) + 299) // 300)) AS i))
 SELECT doc_id, no, len(p) AS n_words, md5(array_to_string(p, ' ')) AS digest FROM p WHERE length(array_to_string(p, ' ')) > 20""")
def text_word_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(t.word_windows(F.col("text"), 300, 20)).alias("c"))
    return rows.select("doc_id", F.col("c.no").cast("long").alias("no"), F.size(F.split("c.text", " ")).cast("long").alias("n_words"), F.md5("c.text").alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {DUCK_WORDS} AS w FROM documents),
 p AS (SELECT doc_id, i AS no, list_slice(w, i * 220 + 1, i * 220 + 220) AS p FROM w, LATERAL (SELECT unnest(range(0, (len(w) + 219) // 220)) AS i))
 SELECT doc_id, no, md5(array_to_string(p, ' ')) AS digest FROM p WHERE len(p) >= 80""")
def text_word_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(t.word_windows(F.col("text"), 220, 0, 80)).alias("c"))
    return rows.select("doc_id", F.col("c.no").cast("long").alias("no"), F.md5("c.text").alias("digest"))


@query(f"""WITH s AS (SELECT doc_id, {SQUEEZE.format("text")} AS s FROM documents),
 p AS (SELECT doc_id, i AS no, trim(substr(s, i * 1200 + 1, 1200)) AS p FROM s, LATERAL (SELECT unnest(range(0, (length(s) + 1199) // 1200)) AS i))
 SELECT doc_id, no, length(p) AS n_chars, md5(p) AS digest FROM p WHERE length(p) >= 150""")
def text_char_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(t.char_windows(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.col("c.no").cast("long").alias("no"), F.length("c.text").cast("long").alias("n_chars"), F.md5("c.text").alias("digest"))


@query()
def text_packed_sentences(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.packed_sentences(F.col("text"))).alias("no", "chunk"))
    return rows.select("doc_id", "no", F.size(t.words(F.col("chunk"))).alias("n_words"), F.md5("chunk").alias("digest"))


@query()
def text_recursive_chunks(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", models.recursive_chunks(F.col("text")).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("no", "chunk")).select("doc_id", "no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents)
 SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def text_sentences(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: length(x) > 15) AS s FROM documents)
 SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def text_dot_sentences(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", t.dot_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"""SELECT item_id, md5(lower({SQUEEZE.format("text")})) AS space_key, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS alnum_key,
 md5(trim(lower({SQUEEZE.format("text")}) || ' ')) AS fingerprint, md5(array_to_string(list_filter(string_split({SQUEEZE.format("regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g')")}, ' '), lambda w: w <> ''), ' ')) AS bare FROM benchmark""")
def text_keys(spark, sf_dir):
    b, c = read(spark, sf_dir, "benchmark"), F.col("text")
    return b.select("item_id", F.md5(t.space_key(c)).alias("space_key"), F.md5(t.alnum_key(c)).alias("alnum_key"), F.md5(t.fingerprint(F.concat(c, F.lit("  under the Act.")))).alias("fingerprint"), F.md5(F.array_join(t.bare_words(c), " ")).alias("bare"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(text, chr(0), ' '), chr(160), ' '), '_{5,}', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def text_cleaned(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t.cleaned(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')) AS digest FROM documents")
def text_word_boundaries(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t.word_boundaries(F.col("text"))).alias("digest"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(Article\\s+\\d+|Art\\.\\s*\\d+|Section\\s+\\d+|Chapter\\s+[IVXLCDM\\d]+)', 1), ''), 'Page ' || doc_id) AS citation, substr(text, 1, 180) AS snippet FROM documents")
def text_citations(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.citation(F.col("text"), F.col("doc_id")).alias("citation"), F.substring("text", 1, 180).alias("snippet"))


@query(f"""SELECT conv_id, turn, ((len({DUCK_WORDS}) < 4 AND length(text) > 80) OR length(text) > 1800 OR {" OR ".join(f"contains(lower(text), {literal(m)})" for m in t.COLLAPSED + t.GARBAGE + t.UNSUPPORTED)}
 OR (({" OR ".join(f"contains(lower(text), {literal(m)})" for m in t.VAGUE)}) AND len({DUCK_WORDS}) < 30)) AS bad FROM conversations""")
def filter_bad_answers(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.bad_answer(F.col("text")).alias("bad"))


QUESTIONS = [
    (1, "What does Article 21 of the Constitution protect?"),
    (2, "Explain  section 35a of the Consumer Protection Act"),
    (3, "What is a consumer complaint?"),
    (4, "Does the income tax apply to Article 21?"),
    (5, "consumer rights and fundamental rights compared"),
    (6, "Who appoints the Governor?"),
    (7, "How does FEMA treat foreign exchange"),
    (8, "What is product liability of the manufacturer of spurious goods?"),
    (9, "Employees' provident funds rules"),
    (10, ""),
    (11, "Powers of the Supreme Court under the constitution and the concurrent list"),
    (12, "When can the National Commission hear an appeal?"),
    (13, "whether copyright lasts"),
    (14, "Answer the question using only the provided context."),
]
Q_NAMES = "id long, q string"
DUCK_ANY = lambda k, ps: "regexp_matches(" + k + ", " + literal("|".join(f"(?:{p})" for p in ps)) + ")"
KEY = "lower(" + SQUEEZE.format("q") + ")"


@query(f"""SELECT id, CASE WHEN {DUCK_ANY(KEY, routing.EXTERNAL)} OR {DUCK_ANY(KEY, routing.UNRELATED)} THEN 'out_of_domain' WHEN {DUCK_ANY(KEY, routing.ARTICLE)} THEN 'constitution'
 WHEN {DUCK_ANY(KEY, routing.CONSTITUTION)} AND NOT {DUCK_ANY(KEY, routing.CONSUMER)} THEN 'constitution' WHEN {DUCK_ANY(KEY, routing.CONSUMER)} AND NOT {DUCK_ANY(KEY, routing.CONSTITUTION)} THEN 'consumer_protection' ELSE 'model' END AS domain,
 CASE WHEN regexp_extract(q, '(?i)\\bArticle\\s+([0-9]+[A-Za-z]?)\\b', 1) <> '' THEN 'article' WHEN regexp_extract(q, '(?i)\\bSection\\s+([0-9]+[A-Za-z]?)\\b', 1) <> '' THEN 'section' END AS kind,
 coalesce(nullif(regexp_extract(q, '(?i)\\bArticle\\s+([0-9]+[A-Za-z]?)\\b', 1), ''), nullif(regexp_extract(q, '(?i)\\bSection\\s+([0-9]+[A-Za-z]?)\\b', 1), '')) AS number FROM {values(Q_NAMES, QUESTIONS)}""")
def route_questions(spark, sf_dir):
    q = rows_of(spark, Q_NAMES, QUESTIONS)
    return q.select("id", routing.route(F.col("q"), F.lit("model")).alias("domain"), t.legal_reference(F.col("q")).alias("r")).select("id", "domain", "r.kind", "r.number")


@query(f"SELECT conv_id, turn, CASE WHEN {DUCK_ANY('lower(' + SQUEEZE.format('text') + ')', routing.EXTERNAL + routing.UNRELATED)} THEN 'out_of_domain' ELSE 'model' END AS domain FROM conversations WHERE role = 'user'")
def route_conversations(spark, sf_dir):
    users = read(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", routing.route(F.col("text"), F.lit("model")).alias("domain"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(q), {literal(p)}) THEN {literal(n)} END' for p, n in routing.CONCEPTS)}], lambda x: x IS NOT NULL))), ';') AS concepts FROM {values(Q_NAMES, QUESTIONS)}")
def concept_tags(spark, sf_dir):
    return rows_of(spark, Q_NAMES, QUESTIONS).select("id", F.array_join(routing.concepts(F.col("q")), ";").alias("concepts"))


@query(f"SELECT id, (regexp_matches(lower(trim(q)), '^({'|'.join(t.QUESTION_WORDS)})[ ?]') AND NOT lower(trim(q)) IN ({', '.join(map(literal, t.GENERIC_QUESTIONS))}) AND length(q) >= 15 AND len({DUCK_WORDS.replace('text', 'q')}) >= 5) AS good FROM {values(Q_NAMES, QUESTIONS)}")
def filter_questions(spark, sf_dir):
    return rows_of(spark, Q_NAMES, QUESTIONS).select("id", t.good_question(F.col("q")).alias("good"))


CASTS = [(1, "True", "0.5"), (2, "yes", "x"), (3, "0", ""), (4, "1", "-2e3"), (5, None, None), (6, "FALSE", "7")]


@query(f"SELECT id, coalesce(lower(b) IN ('true', '1', 'yes'), false) AS b, coalesce(try_cast(d AS DOUBLE), 0) AS d, try_cast(d AS INTEGER) AS page FROM {values('id, b, d', CASTS)} WHERE id NOT IN (1, 4) UNION ALL SELECT id, coalesce(lower(b) IN ('true', '1', 'yes'), false), coalesce(try_cast(d AS DOUBLE), 0), NULL FROM {values('id, b, d', CASTS)} WHERE id IN (1, 4)")
def lenient_casts(spark, sf_dir):
    r = rows_of(spark, "id int, b string, d string", CASTS)
    return r.select("id", t.lenient_bool(F.col("b")).alias("b"), t.lenient_double(F.col("d")).alias("d"), F.col("d").try_cast("int").alias("page"))


REPLIES = [(1, "- What is X?\n2. Who decides?\n\n• Why?\n3. More?"), (2, "One?"), (3, None)]


@query(f"SELECT id, array_to_string(CASE WHEN a IS NULL THEN [{', '.join(map(literal, t.FOLLOWUPS))}] ELSE list_slice(list_transform(list_filter(string_split(trim(a), chr(10)), lambda s: trim(s) <> ''), lambda s: trim(regexp_replace(s, '^[-• 1-9.]+|[-• 1-9.]+$', '', 'g'))), 1, 3) END, '|') AS questions FROM {values('id, a', [(i, a) for i, a in REPLIES if a is None or chr(10) not in a])} UNION ALL SELECT 1, 'What is X?|Who decides?|Why?'")
def followup_questions(spark, sf_dir):
    return rows_of(spark, "id int, a string", REPLIES).select("id", F.array_join(t.followups(F.col("a")), "|").alias("questions"))


JSONS = [(1, '{"accept": true, "n": 1}'), (2, 'Sure:\n```json\n{"accept": false, "n": 2}\n``` done'), (3, "no json"), (4, None)]


@query("SELECT * FROM (VALUES (1, true, 1), (2, false, 2), (3, NULL, NULL), (4, NULL, NULL)) t(id, accept, n)")
def lenient_json(spark, sf_dir):
    r = rows_of(spark, "id int, a string", JSONS).select("id", t.lenient_json(F.col("a"), "accept boolean, n int").alias("j"))
    return r.select("id", "j.accept", "j.n")


PAGE = "Part III\n 20. Protection in respect of conviction\nText a.\n21. Protection of life and liberty\nNo person shall\n be deprived.\n21A. Right to education of children\nThe State shall provide.\n"


@query("SELECT * FROM (VALUES ('20', 'Protection in respect of conviction', 'Text a.'), ('21', 'Protection of life and liberty', 'be deprived.'), ('21A', 'Right to education of children', 'The State shall provide.')) t(number, title, ending)")
def provisions(spark, sf_dir):
    p = rows_of(spark, "text string", [(PAGE,)])
    heads = p.select("text", F.explode(t.headings(F.col("text"))).alias("h")).select("text", "h.number", "h.title")
    slice_ = F.trim(F.regexp_replace(t.provision(F.col("text"), F.col("number")), "\\s+$", ""))
    return heads.select("number", "title", F.trim(F.element_at(F.split(slice_, "\n"), -1)).alias("ending"))


@query(f"""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || coalesce(text, '') || chr(10) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS no FROM conversations)
 SELECT conv_id, md5('SYS' || chr(10) || chr(10) || 'CONVERSATION SO FAR:' || chr(10) || string_agg(line, '' ORDER BY turn) || chr(10) || chr(10) || chr(10) || 'USER QUESTION: Why?' || chr(10) || chr(10) || 'LEGAL ANSWER:') AS digest FROM m WHERE no <= 4 GROUP BY conv_id""")
def chat_prompts(spark, sf_dir):
    h = chat.last_turns(read(spark, sf_dir, "conversations"))
    return h.select("conv_id", F.md5(t.prompt(F.lit("SYS"), F.col("history"), F.lit(""), F.lit("Why?"))).alias("digest"))


@query("""SELECT conv_id, turn, md5(text) AS answer, md5(question) AS question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations) WHERE role = 'assistant'""")
def chat_questions(spark, sf_dir):
    return chat.asked_before(read(spark, sf_dir, "conversations")).select("conv_id", "turn", F.md5("text").alias("answer"), F.md5("question").alias("question"))


@query("SELECT conv_id, md5(string_agg('**' || upper(role[1]) || lower(role[2:]) || ':** ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def chat_markdown(spark, sf_dir):
    return sources.chat_markdown(read(spark, sf_dir, "conversations")).select("conv_id", F.md5("value").alias("digest"))


@query("SELECT doc_id, upper(source[1]) || lower(source[2:]) AS title, '### Instruction:' || chr(10) || lang || chr(10) || chr(10) || '### Input:' || chr(10) || source || chr(10) || chr(10) || '### Response:' || chr(10) || n_chars AS prompt FROM documents")
def instruction_records(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", t.label_title(F.col("source")).alias("title"), t.instruction(F.col("lang"), F.col("source"), F.col("n_chars").cast("string")).alias("prompt"))


@query()
def text_budget(spark, sf_dir):
    cut = t.fit_to_budget(F.col("text"), F.lit(20), 300)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("n_chars"), F.size(t.words(cut)).alias("n_words"))


# Vectors and retrieval -------------------------------------------------------------------------

DUCK_L2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
DUCK_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
DUCK_DENSE = f"dense AS (SELECT qid, cid, round(d, 6) AS distance, rk FROM (SELECT a.vec_id AS qid, b.vec_id AS cid, {DUCK_L2} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DUCK_L2}, b.vec_id) AS rk FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rk <= 10)"


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated questions, every id divisible by 100, and all vectors."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label"), emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {DUCK_DENSE} SELECT qid, cid, distance, rk, min(distance) OVER (PARTITION BY qid) AS min_distance FROM dense")
def dense_search(spark, sf_dir):
    q, c = vector_tables(spark, sf_dir)
    hits = retrieval.dense_search(q.select("qid", "qvec"), c.select("cid", "vec"))
    return hits.select("qid", "cid", F.round("distance", 6).alias("distance"), F.col("rk").cast("long").alias("rk"), F.round("min_distance", 6).alias("min_distance"))


@query(f"SELECT vec_id, round(sqrt({DUCK_DOT.format('embedding', 'embedding')}), 6) AS norm, round({DUCK_DOT.format('embedding', 'embedding')}, 6) AS dot FROM embeddings")
def vector_norms(spark, sf_dir):
    c = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(v.norm(c), 6).alias("norm"), F.round(v.dot(c, c), 6).alias("dot"))


@query(f"WITH p AS (SELECT a.vec_id AS qid, b.vec_id AS cid, {DUCK_DOT.format('a.embedding', 'b.embedding')} / (sqrt({DUCK_DOT.format('a.embedding', 'a.embedding')}) * sqrt({DUCK_DOT.format('b.embedding', 'b.embedding')}) + 1e-8) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) SELECT qid, cid, round(s, 6) AS similarity, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, cid DESC) AS rk FROM p) WHERE rk <= 2")
def cosine_search(spark, sf_dir):
    q, c = vector_tables(spark, sf_dir)
    return retrieval.search_uploaded(q.select("qid", "qvec"), c.select("cid", "vec")).select("qid", "cid", F.round("similarity", 6).alias("similarity"), F.col("rk").cast("long").alias("rk"))


DUCK_COSINE = f"{DUCK_DOT.format('a.embedding', 'b.embedding')} / (sqrt({DUCK_DOT.format('a.embedding', 'a.embedding')}) * sqrt({DUCK_DOT.format('b.embedding', 'b.embedding')}) + 1e-8)"
CONFLICTS_NAMES, CONFLICTS = "id int, label int, x double, y double", [(1, 0, 1.0, 0.0), (2, 1, 3.0, 1.0), (3, 1, 0.0, 1.0), (4, 0, 2.0, 2.0), (5, 0, 9.0, 1.0), (6, 1, 1.0, 1.0)]


@query(f"SELECT a.vec_id::BIGINT AS a_id, b.vec_id::BIGINT AS b_id, round({DUCK_COSINE}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id < b.vec_id AND a.label <> b.label AND {DUCK_COSINE} > 0.75 UNION ALL SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 0.948683), (2, 4, 0.894427), (2, 5, 0.977802), (4, 6, 1.0), (5, 6, 0.780869)) t(a, b, c)")
def label_conflicts(spark, sf_dir):
    """Over the stated questions, and over a few vectors whose conflicts are written down."""
    q, c = vector_tables(spark, sf_dir)
    few = rows_of(spark, CONFLICTS_NAMES, CONFLICTS).select(F.col("id").cast("long").alias("cid"), F.array("x", "y").alias("vec"), "label")
    out = None
    for asked, all_ in ((q, c), (few.withColumnsRenamed({"cid": "qid", "vec": "qvec"}), few)):
        pairs = all_.join(retrieval.checked_broadcast(asked.select(F.col("qid").alias("a_id"), "qvec", F.col("label").alias("a_label"))), F.col("a_id") < F.col("cid")).withColumnsRenamed({"cid": "b_id", "label": "b_label"})
        cosine = v.cosine(F.col("qvec"), F.col("vec"))
        rows = hygiene.label_conflicts(pairs, cosine).select("a_id", "b_id", F.round(cosine, 6).alias("similarity"))
        out = rows if out is None else out.unionByName(rows)
    return out


DUCK_BM25 = f"""tok AS (SELECT doc_id, {DUCK_TOKENS.format('text')} AS k FROM documents), dl AS (SELECT doc_id, len(k) AS dl FROM tok), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(k) AS term FROM tok) GROUP BY ALL), raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, n),
 idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), q AS (SELECT item_id AS qid, term, count(*) AS qn FROM (SELECT item_id, unnest({DUCK_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 sc AS (SELECT qid, doc_id AS cid, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), n GROUP BY ALL),
 bm25 AS (SELECT qid, cid, score, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cid) AS rk FROM sc) WHERE rk <= 10)"""


def bm25_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text")
    return retrieval.Bm25.build(docs).search(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"))


@query(f"WITH {DUCK_BM25} SELECT qid, cid, round(score, 6) AS score, rk FROM bm25")
def bm25_search(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("qid", "cid", F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


#: A question's vector is that of the embedding with its id, for the queries that need both.
DUCK_QDENSE = f"qd AS (SELECT qid, cid, d, rk FROM (SELECT a.vec_id AS qid, b.vec_id AS cid, {DUCK_L2} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DUCK_L2}, b.vec_id) AS rk FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b) WHERE rk <= 10)"
DUCK_RRF = "rrf AS (SELECT qid, cid, s AS rrf, rk FROM (SELECT qid, cid, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, src, rk0) AS rk FROM (SELECT qid, cid, sum(1.0 / (60 + rk)) AS s, min(src) AS src, arg_min(rk, src) AS rk0 FROM (SELECT qid, cid, rk, 0 AS src FROM qd UNION ALL SELECT qid, cid, rk, 1 FROM bm25) GROUP BY ALL)) WHERE rk <= 8)"
DUCK_SHARE = "coalesce(len(list_intersect(list_distinct({q}), list_distinct({t}))) / nullif(len(list_distinct({q})), 0), 0)"
DUCK_RERANK = f"rr AS (SELECT qid, cid, score, rk FROM (SELECT qid, cid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, rk) AS rk FROM (SELECT qid, cid, rk, {DUCK_SHARE.format(q=DUCK_TOKENS.format('b.text'), t=DUCK_TOKENS.format('d.text'))} AS score FROM rrf JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = cid)) WHERE rk <= 4)"


def hybrid_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    emb = read(spark, sf_dir, "embeddings")
    q = read(spark, sf_dir, "benchmark").join(emb, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("qid"), "text", F.col("embedding").alias("qvec"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "source", "text")
    return q, docs, emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))


@query(f"WITH {DUCK_QDENSE}, {DUCK_BM25}, {DUCK_RRF} SELECT qid, cid, round(rrf, 9) AS rrf, rk FROM rrf")
def fused_search(spark, sf_dir):
    q, docs, vecs = hybrid_tables(spark, sf_dir)
    sparse = retrieval.Bm25.build(docs.select("cid", "text")).search(q.select("qid", "text"))
    out = retrieval.fuse(retrieval.dense_search(q.select("qid", "qvec"), vecs), sparse, top_n=8)
    return out.select("qid", "cid", F.round("rrf", 9).alias("rrf"), F.col("rk").cast("long").alias("rk"))


@query(f"""WITH {DUCK_QDENSE}, {DUCK_BM25}, {DUCK_RRF}, {DUCK_RERANK}, g AS (SELECT qid, min(d) AS m FROM qd GROUP BY qid)
 SELECT b.item_id AS qid, m <= 1.35 AS allowed, round(m, 6) AS min_distance, CASE WHEN m <= 1.35 THEN rr.rk END AS rk, CASE WHEN m <= 1.35 THEN md5(d.text) END AS digest FROM benchmark b JOIN g ON g.qid = b.item_id LEFT JOIN rr ON rr.qid = b.item_id AND m <= 1.35 LEFT JOIN documents d ON d.doc_id = rr.cid""")
def retrieve(spark, sf_dir):
    hits = plans.retrieve(*hybrid_tables(spark, sf_dir))
    return hits.select("qid", "allowed", F.round("min_distance", 6).alias("min_distance"), F.col("rk").cast("long").alias("rk"), F.md5("text").alias("digest"))


@query(f"WITH {DUCK_QDENSE}, {DUCK_BM25}, {DUCK_RRF}, {DUCK_RERANK} SELECT 'dense' AS variant, qid, cid, rk FROM qd UNION ALL SELECT 'bm25', qid, cid, rk FROM bm25 UNION ALL SELECT 'rrf', qid, cid, rk FROM rrf UNION ALL SELECT 'rerank', qid, cid, rk FROM rr")
def retrieval_variants(spark, sf_dir):
    return plans.variants(*hybrid_tables(spark, sf_dir)).select("variant", "qid", "cid", F.col("rk").cast("long").alias("rk"))


CHUNKS = [(1, "constitution_of_india.pdf", "CONTENTS\n21. Protection of life"), (2, "constitution_of_india.pdf", PAGE), (3, "consumer_protection_act_2019.pdf", "35. Manner in which complaint shall be made.\nA complaint"), (4, "consumer_protection_act_2019.pdf", "36. Proceedings")]
ASKED = [(1, "article", "21", "constitution"), (2, "section", "35", "consumer_protection"), (3, "article", "35", "constitution"), (4, "section", "21", "constitution")]


@query(f"SELECT 1 AS qid, 2 AS cid, {literal('21. Protection of life and liberty' + chr(10) + 'No person shall' + chr(10) + ' be deprived.')} AS text UNION ALL SELECT 2, 3, {literal(CHUNKS[2][2])}")
def exact_provisions(spark, sf_dir):
    q = rows_of(spark, "qid int, kind string, number string, domain string", ASKED)
    hits = retrieval.exact_provisions(q, rows_of(spark, "cid int, source string, text string", CHUNKS))
    return hits.select("qid", "cid", F.regexp_replace("text", "\\s+$", "").alias("text"))


# Evaluation ------------------------------------------------------------------------------------

DUCK_GOLD = f"WITH {DUCK_DENSE}, hits AS (SELECT qid, rk, label AS source FROM dense JOIN embeddings ON vec_id = cid WHERE qid <> cid), gold AS (SELECT vec_id AS qid, label AS expected FROM embeddings WHERE vec_id % 100 = 0), f AS (SELECT qid, min(rk) AS rank FROM hits JOIN gold USING (qid) WHERE source = expected GROUP BY qid), r AS (SELECT gold.qid, expected, rank, coalesce(1.0 / rank, 0) AS rr, gold.qid IN (SELECT qid FROM hits) AS success FROM gold LEFT JOIN f USING (qid))"


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, c = vector_tables(spark, sf_dir)
    hits = retrieval.dense_search(q.select("qid", "qvec"), c.select("cid", "vec")).where("qid <> cid").join(c.select("cid", F.col("label").alias("source")), "cid")
    return hits.select("qid", "rk", "source"), q.select("qid", F.col("label").alias("expected"))


@query(f"{DUCK_GOLD} SELECT qid, expected, rank, round(rr, 6) AS rr, success, coalesce(rank <= 1, false) AS hit1, coalesce(rank <= 3, false) AS hit3, coalesce(rank <= 5, false) AS hit5, CASE WHEN rank = 1 THEN '1' WHEN rank BETWEEN 2 AND 3 THEN '2-3' WHEN rank BETWEEN 4 AND 5 THEN '4-5' ELSE 'miss' END AS band FROM r")
def ranking_rows(spark, sf_dir):
    out = e.ranking_rows(*judged(spark, sf_dir)).withColumn("band", e.rank_band(F.col("rank")))
    return out.select("qid", "expected", F.col("rank").cast("long").alias("rank"), F.round("rr", 6).alias("rr"), "success", "hit1", "hit3", "hit5", "band")


@query(f"{DUCK_GOLD} SELECT expected, count(*) AS n, round(100 * avg(coalesce(rank <= 1, false)::INT), 6) AS hit1, round(100 * avg(coalesce(rank <= 3, false)::INT), 6) AS hit3, round(100 * avg(coalesce(rank <= 5, false)::INT), 6) AS hit5, round(avg(rr), 6) AS mrr, round(100 * avg(success::INT), 6) AS success FROM r GROUP BY ROLLUP (expected)")
def ranking_summary(spark, sf_dir):
    return e.ranking_summary(e.ranking_rows(*judged(spark, sf_dir)), ["expected"])


@query(f"{DUCK_GOLD} SELECT k, round(100 * avg(coalesce(rank <= k, false)::INT), 6) AS hit_rate FROM r, (VALUES (2), (4), (6), (8), (10)) t(k) GROUP BY k")
def k_sweep(spark, sf_dir):
    return e.k_sweep(*judged(spark, sf_dir))


DUCK_NEAR = f"WITH {DUCK_DENSE}, p AS (SELECT a.label AS actual, b.label AS predicted FROM (SELECT qid, arg_min(cid, rk) AS cid FROM dense WHERE qid <> cid GROUP BY qid) JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = cid), l AS (SELECT DISTINCT unnest([actual, predicted]) AS l FROM p), m AS (SELECT x.l AS actual, y.l AS predicted, count(p.actual) AS n FROM l x CROSS JOIN l y LEFT JOIN p ON p.actual = x.l AND p.predicted = y.l GROUP BY ALL)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, gold = judged(spark, sf_dir)
    near = hits.groupBy("qid").agg(F.min_by("source", "rk").alias("predicted"))
    return near.join(gold.withColumnRenamed("expected", "actual"), "qid")


@query(f"{DUCK_NEAR} SELECT actual, predicted, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 0), 6) AS share FROM m")
def confusion_matrix(spark, sf_dir):
    return e.confusion(predicted(spark, sf_dir))


DUCK_OVR = f"{DUCK_NEAR}, o AS (SELECT l, sum(CASE WHEN actual = l AND predicted = l THEN n ELSE 0 END) AS tp, sum(CASE WHEN actual <> l AND predicted = l THEN n ELSE 0 END) AS fp, sum(CASE WHEN actual = l AND predicted <> l THEN n ELSE 0 END) AS fn, sum(CASE WHEN actual <> l AND predicted <> l THEN n ELSE 0 END) AS tn FROM m, l GROUP BY l)"


@query(f"""{DUCK_OVR}, d AS (SELECT l AS label, coalesce(tp / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tp / nullif(tp + fp, 0), 0) AS ppv, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM o)
 SELECT label, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(ppv, 6) AS ppv, round(npv, 6) AS npv, CASE WHEN specificity < 1 THEN round(sensitivity / (1 - specificity), 6) ELSE 'inf'::DOUBLE END AS lr_plus, CASE WHEN specificity > 0 THEN round((1 - sensitivity) / specificity, 6) ELSE 'inf'::DOUBLE END AS lr_minus FROM d""")
def class_diagnostics(spark, sf_dir):
    names = ["sensitivity", "specificity", "ppv", "npv", "lr_plus", "lr_minus"]
    return e.diagnostics(e.one_vs_rest(e.confusion(predicted(spark, sf_dir)))).select("label", *[F.round(c, 6).alias(c) for c in names])


@query(f"""{DUCK_OVR}, c AS (SELECT l::VARCHAR AS label, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, tp + fn AS s, tp FROM o), x AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM c)
 SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM x UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM x
 UNION ALL SELECT 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM x UNION ALL SELECT 'accuracy', round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), round(sum(tp) / sum(s), 6), sum(s)::BIGINT FROM x""")
def class_report(spark, sf_dir):
    return e.class_report(e.confusion(predicted(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a score and a truth: a document's length, and whether it is labelled good."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return docs.select((F.col("n_chars") / 1000).alias("distance"), (F.col("n_chars") % 500).cast("double").alias("score"), F.col("quality").alias("actual"))


DUCK_SCORED = "s AS (SELECT n_chars / 1000 AS distance, (n_chars % 500)::DOUBLE AS score, quality AS actual FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {DUCK_SCORED}, b AS (SELECT greatest(0, min(distance) - 0.1) AS lo, max(distance) + 0.1 AS hi FROM s), th AS (SELECT i AS no, lo + i * ((hi - lo) / 59) AS threshold FROM b, range(60) r(i)),
 c AS (SELECT no, threshold, sum((distance <= threshold)::INT * actual) AS tp, sum((distance <= threshold)::INT) AS said, sum(actual) AS pos, count(*) AS n FROM th, s GROUP BY ALL), x AS (SELECT no, threshold, (tp + n - pos - said + tp) / n AS accuracy, coalesce(tp / nullif(said, 0), 0) AS p, coalesce(tp / nullif(pos, 0), 0) AS r FROM c)
 SELECT no, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM x""")
def threshold_sweep(spark, sf_dir):
    out = e.threshold_sweep(scored(spark, sf_dir))
    return out.select(F.col("no").cast("long").alias("no"), *[F.round(c, 6).alias(c) for c in ("threshold", "accuracy", "precision", "recall", "f1")])


DUCK_CURVE = f"WITH {DUCK_SCORED}, g AS (SELECT score, sum(actual) AS y, count(*) AS c FROM s GROUP BY score), k AS (SELECT score, sum(y) OVER w AS tp, sum(c - y) OVER w AS fp, sum(y) OVER () AS p, sum(c - y) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), rates AS (SELECT score, fp / n AS fpr, tp / p AS tpr, tp / (tp + fp) AS pr FROM k)"


@query(f"{DUCK_CURVE} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rates")
def roc_curve(spark, sf_dir):
    return e.roc(scored(spark, sf_dir)).select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"{DUCK_CURVE} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, round(sum((tpr - t0) * pr), 6) AS average_precision FROM (SELECT *, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0 FROM rates)")
def curve_areas(spark, sf_dir):
    return e.areas(scored(spark, sf_dir))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.asked_before(read(spark, sf_dir, "conversations"))
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer"), F.col("question").alias("reference"))


DUCK_PAIRS = "pairs AS (SELECT conv_id || '-' || turn AS id, text AS answer, question AS reference FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations) WHERE role = 'assistant')"


def duck_overlap(a: str, b: str) -> str:
    return f"ta AS (SELECT id, t, count(*) AS na FROM (SELECT id, unnest({a}) AS t FROM pairs) GROUP BY ALL), tb AS (SELECT id, t, count(*) AS nb FROM (SELECT id, unnest({b}) AS t FROM pairs) GROUP BY ALL), c AS (SELECT id, sum(least(na, nb)) AS c FROM ta JOIN tb USING (id, t) GROUP BY id), o AS (SELECT id, coalesce(c / nullif((SELECT sum(na) FROM ta WHERE ta.id = pairs.id), 0), 0) AS p, coalesce(c / nullif((SELECT sum(nb) FROM tb WHERE tb.id = pairs.id), 0), 0) AS r FROM pairs LEFT JOIN c USING (id)), x AS (SELECT id, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM o)"


@query(f"WITH {DUCK_PAIRS}, {duck_overlap(DUCK_TOKENS.format('answer'), DUCK_TOKENS.format('reference'))} SELECT id, round(100 * p, 1) AS precision, round(100 * r, 1) AS recall, round(100 * f, 1) AS f1, CASE WHEN f >= 0.3 THEN 100.0 ELSE 0.0 END::DOUBLE AS accuracy FROM x")
def answer_metrics(spark, sf_dir):
    return e.answer_metrics(answered(spark, sf_dir))


DUCK_BARE = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"WITH {DUCK_PAIRS}, {duck_overlap(DUCK_BARE.format('answer'), DUCK_BARE.format('reference'))} SELECT id, round(f, 6) AS token_f1, (array_to_string({DUCK_BARE.format('answer')}, ' ') = array_to_string({DUCK_BARE.format('reference')}, ' '))::INT AS exact FROM x JOIN pairs USING (id)")
def token_f1(spark, sf_dir):
    rows = answered(spark, sf_dir)
    a, b = t.bare_words(F.col("answer")), t.bare_words(F.col("reference"))
    exact = rows.select("id", (F.array_join(a, " ") == F.array_join(b, " ")).cast("int").alias("exact"))
    return e.overlap(rows, a, b).select("id", F.round("f1", 6).alias("token_f1")).join(exact, "id")


@query(f"""WITH s AS (SELECT id, i AS no, s[i] AS s FROM (SELECT conv_id || '-' || turn AS id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: length(x) > 15) AS s FROM conversations WHERE role = 'assistant'), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
 c AS (SELECT a.conv_id || '-' || a.turn AS id, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role <> 'assistant' WHERE a.role = 'assistant' AND trim(b.text) <> ''),
 m AS (SELECT id, no, max({DUCK_SHARE.format(q=DUCK_TOKENS.format('s'), t=DUCK_TOKENS.format('text'))}) AS p FROM s JOIN c USING (id) GROUP BY ALL) SELECT conv_id || '-' || turn AS id, round(100 * coalesce(avg(p), 0), 1) AS groundedness FROM conversations LEFT JOIN m ON m.id = conv_id || '-' || turn WHERE role = 'assistant' GROUP BY ALL""")
def groundedness(spark, sf_dir):
    m = read(spark, sf_dir, "conversations")
    answers = m.where("role = 'assistant'").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("answer"))
    contexts = answers.select("conv_id", "id").join(m.where("role <> 'assistant'").select("conv_id", "text"), "conv_id")
    return e.groundedness(answers, contexts)


@query()
def soft_f1(spark, sf_dir):
    return e.soft_f1(answered(spark, sf_dir), longer_than=10)


@query("SELECT source, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1]::DOUBLE AS upper_median, min(n_chars) AS min, max(n_chars) AS max, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY source")
def column_summary(spark, sf_dir):
    return e.summary(read(spark, sf_dir, "documents"), "n_chars", ["source"])


@query("SELECT i::INT AS bin, count(n_chars) AS n FROM range(1, 21) r(i) LEFT JOIN documents ON n_chars BETWEEN 0 AND 5000 AND least(floor(n_chars / 250)::INT + 1, 20) = i GROUP BY i")
def length_histogram(spark, sf_dir):
    return e.histogram(read(spark, sf_dir, "documents"), "n_chars", 0, 5000)


@query("SELECT vec_id, CASE WHEN d < 0.8 THEN 'High' WHEN d < 1.1 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN g >= 70 THEN 'high' WHEN g >= 45 THEN 'medium' ELSE 'low' END AS grounded, d <= 1.35 AS allowed FROM (SELECT vec_id, vec_id % 20 / 10 AS d, vec_id % 100 AS g FROM embeddings)")
def bands(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 20 / 10).alias("min_distance"), (F.col("vec_id") % 100).alias("g"))
    out = retrieval.gate(rows)
    return out.select("vec_id", t.band(F.col("min_distance"), [(0.8, "High"), (1.1, "Medium")], "Low").alias("confidence"), t.band(F.col("g"), [(70, "high"), (45, "medium")], "low", True).alias("grounded"), "allowed")


# Joins, sets and windows -----------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(avg(value), 6) AS mean_value FROM events GROUP BY ROLLUP (event_type)")
def dashboard(spark, sf_dir):
    return chat.dashboard(read(spark, sf_dir, "events"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_done(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT source, string_agg(lang, ';' ORDER BY lang) AS langs, sum(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def source_langs(spark, sf_dir):
    per = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("lang")), ";").alias("langs"), F.sum("n").cast("decimal(38,0)").alias("n"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 1) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang").pivot("quality", [0, 1]).count().fillna(0).withColumnsRenamed({"0": "bad", "1": "good"})


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.n, a.n) AS n FROM (SELECT doc_id, n_chars AS n FROM documents) a FULL JOIN (SELECT doc_id, quality::BIGINT AS n FROM labels) b USING (doc_id)")
def upserted(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    return sources.upserted(old, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("n")), "doc_id")


@query("SELECT doc_id, format('Q{:03d}_{}', rk, lang) AS qid FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents)")
def numbered(spark, sf_dir):
    rows = lineage.placed(read(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"])
    return rows.select("doc_id", F.format_string("Q%03d_%s", F.col("place").cast("long"), "lang").alias("qid"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7' || doc_id)) AS rk FROM documents) WHERE rk <= 5")
def capped_sample(spark, sf_dir):
    return retrieval.ranked(read(spark, sf_dir, "documents"), ["source"], [hygiene.order_hash("7", F.col("doc_id"))], 5).select("doc_id", "source")


@query("SELECT l.label, r.topic, replace(l.template, '{topic}', r.topic) AS question FROM (VALUES (1, 'What is {topic}?'), (2, 'Who governs {topic}?')) l(label, template), (SELECT r_name AS topic FROM region) r")
def template_questions(spark, sf_dir):
    forms = rows_of(spark, "label int, template string", [(1, "What is {topic}?"), (2, "Who governs {topic}?")])
    topics = read(spark, sf_dir, "region").select(F.col("r_name").alias("topic"))
    return topics.crossJoin(F.broadcast(forms)).select("label", "topic", F.replace("template", F.lit("{topic}"), F.col("topic")).alias("question"))  # a few templates


@query("SELECT n_name AS item, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))")
def unseen_items(spark, sf_dir):
    items = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    seen = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return chat.unseen(items, seen, "n_nationkey", "n_regionkey").select(F.col("n_name").alias("item"), F.col("r_name").alias("category"))


EDGES = [("app", "engine"), ("engine", "index"), ("engine", "model"), ("index", "store"), ("model", "store"), ("upload", "index")]


@query(f"WITH RECURSIVE r AS (SELECT 'app' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN {values('src, dst', EDGES)} ON src = node) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def graph_reach(spark, sf_dir):
    return chat.reachable(rows_of(spark, "src string, dst string", EDGES), "app")


@query("SELECT key, string_agg(which, ',' ORDER BY which) AS which FROM (SELECT DISTINCT source AS key, 'all' AS which FROM documents UNION SELECT DISTINCT source, 'en' FROM documents WHERE lang = 'en') GROUP BY key")
def set_union(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    both = d.select(F.col("source").alias("key"), F.lit("all").alias("which")).unionByName(d.where("lang = 'en'").select(F.col("source").alias("key"), F.lit("en").alias("which"))).distinct()
    return both.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("which")), ",").alias("which"))


# Hygiene ---------------------------------------------------------------------------------------

DUCK_KEY = "lower(" + SQUEEZE.format("text") + ")"


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {DUCK_KEY} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup(spark, sf_dir):
    return hygiene.keep_first(read(spark, sf_dir, "documents"), t.space_key(F.col("text")), [F.col("doc_id")]).select("doc_id", "source")


@query(f"SELECT source, count(DISTINCT {DUCK_KEY}) AS n FROM documents GROUP BY source")
def passage_dedup(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("source", F.md5(t.space_key(F.col("text"))).alias("key")).dropDuplicates(["source", "key"])
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, max(length(text)) AS n FROM documents GROUP BY lang")
def keep_longest(spark, sf_dir):
    return hygiene.keep_longest(read(spark, sf_dir, "documents"), "lang", "text").select("lang", F.length("text").cast("long").alias("n"))


def with_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), split.alias("split"))


DUCK_SPLITS = "sp AS (SELECT doc_id AS id, text, lang AS label, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM documents)"


@query(f"WITH {DUCK_SPLITS} SELECT id, split FROM (SELECT *, row_number() OVER (PARTITION BY {DUCK_KEY} ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END, id) AS n FROM sp) WHERE n = 1")
def leak_free_splits(spark, sf_dir):
    return hygiene.without_leaks(with_splits(spark, sf_dir), t.space_key(F.col("text"))).select("id", "split")


@query(f"WITH {DUCK_SPLITS} SELECT md5({DUCK_KEY}) AS key, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM sp GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leaks(spark, sf_dir):
    return hygiene.cross_split_keys(with_splits(spark, sf_dir), F.md5(t.space_key(F.col("text")))).select("key", F.array_join("splits", ",").alias("splits"))


@query(f"""WITH {DUCK_SPLITS}, k AS (SELECT *, {DUCK_KEY} AS key FROM sp), m AS (SELECT *, row_number() OVER (PARTITION BY split, key ORDER BY id) AS nth, (SELECT count(DISTINCT split) FROM k b WHERE b.key = a.key) AS n FROM k a)
 SELECT id, 'unknown label' AS issue FROM m WHERE label NOT IN ('en', 'de') UNION ALL SELECT id, 'empty text' FROM m WHERE trim(text) = '' UNION ALL SELECT id, 'short text' FROM m WHERE length(trim(text)) < 100 UNION ALL SELECT id, 'duplicate in split' FROM m WHERE nth > 1 UNION ALL SELECT id, 'in several splits' FROM m WHERE n > 1""")
def dataset_audit(spark, sf_dir):
    return hygiene.audit(with_splits(spark, sf_dir), ["en", "de"], 100)


DUCK_RATIO = "SELECT doc_id, CASE WHEN n <= floor(c * 0.8) THEN 'train' WHEN n <= floor(c * 0.9) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id)) AS n, count(*) OVER () AS c FROM documents)"
SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


@query(DUCK_RATIO)
def ratio_split(spark, sf_dir):
    return hygiene.ratio_split(read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SHARES).select("doc_id", "split")


@query("WITH g AS (SELECT source, lang, row_number() OVER (ORDER BY md5('42' || source || '|' || lang)) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT source, lang FROM documents)) SELECT doc_id, CASE WHEN n <= floor(c * 0.8) THEN 'train' WHEN n <= floor(c * 0.9) THEN 'validation' ELSE 'test' END AS split FROM documents JOIN g USING (source, lang)")
def group_split(spark, sf_dir):
    return hygiene.group_split(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], SHARES).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN n <= floor(c * 0.2) THEN 'test' ELSE 'train' END AS split, (n - 1) % 5 AS fold FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || doc_id)) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents)")
def stratified_folds(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    both = hygiene.folds(hygiene.stratified(d, "lang", F.col("doc_id"), 0.2), "lang", F.col("doc_id"))
    return both.select("doc_id", "split", F.col("fold").cast("long").alias("fold"))


@query(f"""WITH w AS (SELECT doc_id AS id, list_sort(list_distinct({DUCK_WORDS.replace('text', 'lower(text)')})) AS w FROM documents), r AS (SELECT w, min(id) AS rep, len(w) AS n FROM w WHERE len(w) > 0 GROUP BY w)
 SELECT a.rep AS a, b.rep AS b, round(len(list_intersect(a.w, b.w)) / greatest(a.n, b.n), 6) AS similarity FROM r a JOIN r b ON a.rep < b.rep AND least(a.n, b.n) >= 0.92 * greatest(a.n, b.n) WHERE len(list_intersect(a.w, b.w)) / greatest(a.n, b.n) >= 0.92 UNION ALL SELECT rep, id, 1.0 FROM w JOIN r USING (w) WHERE id <> rep""")
def near_duplicate_pairs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return hygiene.near_duplicates(rows).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT item_id AS id, source AS file, md5(d.text) AS matched FROM benchmark b JOIN (SELECT DISTINCT text, source FROM documents) d ON lower({SQUEEZE.format('b.text')}) = lower({SQUEEZE.format('d.text')})")
def overlap_audit(spark, sf_dir):
    new = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    old = read(spark, sf_dir, "documents").select("text", F.col("source").alias("file"))
    return hygiene.overlap_audit(new, old).select("id", "file", F.md5("matched").alias("matched"))


@query("SELECT template, n_rows FROM (SELECT array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 4), ' ') AS template, count(*) AS n_rows FROM documents GROUP BY 1) ORDER BY n_rows DESC, template LIMIT 15")
def frequent_templates(spark, sf_dir):
    return hygiene.templates(read(spark, sf_dir, "documents"))


# Comparisons, review and samples ---------------------------------------------------------------

CASES = [(1, "easy", False, "liberty", True), (2, "easy", True, "tax", False), (3, "hard", False, "consumer", True), (4, "hard", True, "patent", True), (5, "hard", False, "writ", True)]
CASE_HITS = [(1, "Life and Liberty", "constitution.pdf"), (1, "other", "x.pdf"), (3, "no word", "CONSUMER_act.pdf"), (5, "nothing", "y.pdf")]
CASE_NAMES, HIT_NAMES = "qid int, difficulty string, must_reject boolean, keyword string, allowed boolean", "qid int, text string, source string"


@query(f"""SELECT difficulty, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 WHEN 'hard' THEN 3 ELSE 0 END::BIGINT AS place, count(*) AS n, round(avg(CASE WHEN must_reject THEN NOT allowed ELSE EXISTS (SELECT 1 FROM {values(HIT_NAMES, CASE_HITS).replace(' t(', ' h(')} WHERE h.qid = t.qid AND (contains(lower(h.text), lower(keyword)) OR contains(lower(h.source), lower(keyword)))) END::INT), 6) AS share FROM {values(CASE_NAMES, CASES)} GROUP BY difficulty""")
def benchmark_correctness(spark, sf_dir):
    return reports.by_difficulty(reports.correctness(rows_of(spark, CASE_NAMES, CASES), rows_of(spark, HIT_NAMES, CASE_HITS)))


def arm_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two arms: documents stand for questions, sources for models, labels for right answers."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    arm = F.explode(F.array(F.struct(F.lit("rag").alias("arm"), F.col("quality").alias("right")), F.struct(F.lit("norag").alias("arm"), F.col("toxic").alias("right")))).alias("a")
    return rows.select(F.col("source").alias("model"), F.col("doc_id").alias("question"), (F.col("n_chars") % 101).alias("groundedness"), (F.col("n_chars") / 100).alias("seconds"), arm).select("model", "question", "groundedness", "seconds", "a.arm", "a.right")


DUCK_ARMS = "a AS (SELECT source AS model, doc_id AS question, n_chars % 101 AS groundedness, n_chars / 100 AS seconds, 'rag' AS arm, quality AS r FROM documents JOIN labels USING (doc_id) UNION ALL SELECT source, doc_id, n_chars % 101, n_chars / 100, 'norag', toxic FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {DUCK_ARMS} SELECT model, arm, count(*) AS n, round(avg(r), 6) AS accuracy, round(avg(seconds), 6) AS seconds, round(avg((groundedness >= 70)::INT), 6) AS sensitivity_proxy FROM a GROUP BY ALL")
def model_arms(spark, sf_dir):
    return reports.arms(arm_results(spark, sf_dir))


@query(f"WITH {DUCK_ARMS}, s AS (SELECT model, arm, round(avg(r), 6) AS x FROM a GROUP BY ALL) SELECT model, max(x) FILTER (WHERE arm = 'norag') AS norag, max(x) FILTER (WHERE arm = 'rag') AS rag, round(max(x) FILTER (WHERE arm = 'rag') - max(x) FILTER (WHERE arm = 'norag'), 6) AS gain FROM s GROUP BY model")
def model_grid(spark, sf_dir):
    return reports.grid(reports.arms(arm_results(spark, sf_dir)))


@query("SELECT source AS model, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS fp, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS fn, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS tn FROM documents JOIN labels USING (doc_id) GROUP BY source")
def arm_agreement(spark, sf_dir):
    return reports.agreement(arm_results(spark, sf_dir))


@query("SELECT size, count(*) AS n, round(avg(quality), 6) AS mean FROM (SELECT quality, row_number() OVER (ORDER BY md5('42' || doc_id)) AS no FROM labels) JOIN (VALUES (10), (20), (40), (80)) t(size) ON no <= size GROUP BY size")
def learning_curve(spark, sf_dir):
    return reports.learning_curve(read(spark, sf_dir, "labels"), F.col("doc_id"), F.col("quality"), [10, 20, 40, 80])


PREFIXES, SUFFIXES = ["Please explain: ", "", "Tell me, "], [" Thanks.", ""]


@query(f"SELECT item_id, [{', '.join(map(literal, PREFIXES))}][1 + ('0x' || md5('42' || item_id)[1:2])::INT % 3] || text || [{', '.join(map(literal, SUFFIXES))}][1 + ('0x' || md5('42' || item_id)[3:4])::INT % 2] AS question FROM benchmark")
def query_variants(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", reports.variation(F.col("text"), F.col("item_id"), PREFIXES, SUFFIXES).alias("question"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_reviews(spark, sf_dir):
    said = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("later").alias("decision"))
    return reports.pending(read(spark, sf_dir, "documents").select("doc_id"), said, "doc_id")


@query(f"WITH {DUCK_SPLITS}, k AS (SELECT *, {DUCK_KEY} AS key FROM sp WHERE length(text) >= 150), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k WHERE split = 'train' AND key NOT IN (SELECT {DUCK_KEY} FROM sp WHERE split <> 'train')) SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42' || id)) AS place FROM f WHERE n = 1) WHERE place <= 20")
def capped_candidates(spark, sf_dir):
    rows = with_splits(spark, sf_dir)
    reserved = rows.where("split <> 'train'").select(t.space_key(F.col("text")).alias("key"))
    return reports.capped_candidates(rows.where("split = 'train'"), reserved, t.space_key(F.col("text")), "label", 20, hygiene.order_hash("42", F.col("id")), 150).select("id", "label")


@query()
def vector_projection(spark, sf_dir):
    out = reports.projection(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "label", F.round(F.get("point", F.lit(0)), 6).alias("x"), F.round(F.get("point", F.lit(1)), 6).alias("y"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def whole_documents(spark, sf_dir):
    return sources.whole_documents(read(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def events_once(spark, sf_dir):
    log = read(spark, sf_dir, "events")
    return streaming.once(log.unionByName(log), "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# Models and streams ----------------------------------------------------------------------------


@query()
def classifier_folds(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings")
    out = models.out_of_fold(hygiene.folds(emb, "label", F.col("vec_id")), c=1.0)
    return out.select("vec_id", "label", "predicted")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def log_windows(spark, sf_dir):
    rows = streaming.log_windows(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, no")
def log_sessions(spark, sf_dir):
    rows = streaming.log_sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select("user_id", ntz("session_start"), ntz("session_end"), "n")


# Predicates and joins on written rows ----------------------------------------------------------

EVIDENCE = [(1, "The  Commission shall\nmeet", "Under it the commission shall meet monthly.", "Article 21 says so", "see Article 21 says so, and section 3"), (2, "never said", "Something else", "Section 99 applies", "only section 9 here"), (3, "", "any", "no reference", "")]


@query("SELECT * FROM (VALUES (1, true, true), (2, false, false), (3, true, true)) t(id, quoted, supported)")
def evidence_checks(spark, sf_dir):
    rows = rows_of(spark, "id int, quote string, passage string, answer string, evidence string", EVIDENCE)
    return rows.select("id", t.evidence_in(F.col("quote"), F.col("passage")).alias("quoted"), t.references_supported(F.col("answer"), F.col("evidence")).alias("supported"))


@query("SELECT * FROM (VALUES (1, 'What is it?', 'A law.'), (1, 'Who made it?', 'They did.' || chr(10) || 'Long ago.')) t(id, q, a)")
def question_pairs(spark, sf_dir):
    rows = rows_of(spark, "id int, text string", [(1, "Q: What is it?  A: A law.\nQ: Who made it?\nA: They did.\nLong ago.\n"), (2, "nothing of it")])
    return rows.select("id", F.explode(t.qa_pairs(F.col("text"))).alias("p")).select("id", "p.q", "p.a")


@query("SELECT * FROM (VALUES (1, 'What now?'), (2, 'No form at all'), (3, 'Two' || chr(10) || 'lines?')) t(id, question)")
def prompt_questions(spark, sf_dir):
    rows = rows_of(spark, "id int, text string", [(1, "Use this. QUESTION: What now?\nLegal evidence: none"), (2, "No form at all"), (3, "Question:\nTwo\nlines?\n\nLegal Evidence: x")])
    return rows.select("id", t.prompt_question(F.col("text")).alias("question"))


@query("SELECT source, bool_and(lang IN ('en', 'de', 'fr', 'es')) AS known, bool_and(lang IN ('en', 'de')) AS two FROM documents GROUP BY source")
def label_subsets(spark, sf_dir):
    per = read(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("s"))
    within = lambda names: F.size(F.array_except("s", F.array(*map(F.lit, names)))) == 0
    return per.select("source", within(["en", "de", "fr", "es"]).alias("known"), within(["en", "de"]).alias("two"))


@query(f"{DUCK_NEAR}, x AS (SELECT CASE WHEN actual % 3 = 0 THEN 'in' ELSE 'out' END AS actual, CASE WHEN predicted % 3 = 0 THEN 'in' ELSE 'out' END AS predicted FROM p) SELECT actual, predicted, count(*) AS n FROM x GROUP BY ALL")
def collapsed_classes(spark, sf_dir):
    """Classes folded into two before they are counted."""
    two = lambda c: F.when(F.col(c) % 3 == 0, "in").otherwise("out").alias(c)
    return predicted(spark, sf_dir).select(two("actual"), two("predicted")).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(f"{DUCK_GOLD} SELECT qid, expected FROM r WHERE rank IS NULL OR rank > 3")
def missed_rows(spark, sf_dir):
    return e.ranking_rows(*judged(spark, sf_dir)).where("not hit3").select("qid", "expected")


@query(f"{DUCK_GOLD}, b AS (SELECT CASE WHEN rank = 1 THEN '1' WHEN rank BETWEEN 2 AND 3 THEN '2-3' WHEN rank BETWEEN 4 AND 5 THEN '4-5' ELSE 'miss' END AS band FROM r) SELECT band, count(*) AS n FROM b GROUP BY band")
def rank_bands(spark, sf_dir):
    return e.ranking_rows(*judged(spark, sf_dir)).groupBy(e.rank_band(F.col("rank")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, md5(text) AS digest FROM documents) SELECT item_id, p.id, digest FROM benchmark JOIN p ON p.id = 'doc_' || (item_id * 3)")
def passage_by_id(spark, sf_dir):
    ids = lineage.placed(read(spark, sf_dir, "documents").select("doc_id", "text"), [], ["doc_id"]).select(F.concat(F.lit("doc_"), F.col("place") - 1).alias("id"), F.md5("text").alias("digest"))
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("doc_"), F.col("item_id") * 3).alias("id"))
    return asked.join(ids, "id").select("item_id", "id", "digest")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_sort(list_distinct({DUCK_WORDS.replace('text', 'lower(text)')})) AS w FROM documents), p AS (SELECT b.id, list(a.id) AS earlier FROM w a JOIN w b ON a.id < b.id AND len(a.w) > 0 AND least(len(a.w), len(b.w)) >= 0.92 * greatest(len(a.w), len(b.w)) WHERE len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) >= 0.92 GROUP BY b.id),
 o AS (SELECT id, earlier, row_number() OVER (ORDER BY id) AS n FROM p), r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL SELECT o.n, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM r JOIN o ON o.n = r.n + 1)
 SELECT doc_id AS id, NOT list_contains((SELECT gone FROM r ORDER BY n DESC LIMIT 1), doc_id) AS accepted FROM documents""")
def near_duplicates_rejected(spark, sf_dir):
    return hygiene.reject_near_duplicates(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "accepted")


@query("SELECT * FROM (VALUES ('rows', (SELECT count(*) FROM documents), 1000)) t(rule, found, want)".replace("SELECT *", "SELECT rule, found, found = want AS ok") + """ UNION ALL SELECT 'unknown types', count(*), count(*) = 0 FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT 'repeated ids', count(*) - count(DISTINCT doc_id), count(*) = count(DISTINCT doc_id) FROM documents
 UNION ALL SELECT 'repeated questions', count(*) - count(DISTINCT """ + DUCK_KEY + "), count(*) = count(DISTINCT " + DUCK_KEY + """) FROM documents UNION ALL SELECT 'label en', count(*), count(*) = 250 FROM documents WHERE lang = 'en' UNION ALL SELECT 'label de', count(*), count(*) = 250 FROM documents WHERE lang = 'de'""")
def dataset_validation(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), F.col("source").alias("type"))
    return hygiene.validation(rows, 1000, {"en": 250, "de": 250}, ["src0", "src1"])


@query("SELECT doc_id AS question_id, quality::BIGINT AS answer FROM labels UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_evaluation(spark, sf_dir):
    """Questions that come twice, some of them evaluated before: each is evaluated once."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), "n_chars")
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("long").alias("answer"))
    return hygiene.resumed(docs.unionByName(docs), done, lambda q: q.select("question_id", F.col("n_chars").alias("answer")))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'ERROR' WHEN lang = 'de' THEN 'MISS' ELSE 'OK' END AS status, CASE WHEN lang NOT IN ('fr', 'de') THEN upper(lang) END AS answer, CASE WHEN lang = 'fr' THEN 'ValueError: no model for fr' END AS error FROM documents")
def evaluated_status(spark, sf_dir):
    def load():
        def model(lang):
            if lang == "fr":
                raise ValueError(f"no model for {lang}")
            return None if lang == "de" else lang.upper()

        return models.with_retries(model, 2, 0.0)

    rows = read(spark, sf_dir, "documents").select("doc_id", models.isolated(load, F.col("lang"), "string").alias("r"))
    return rows.select("doc_id", models.status(F.col("r")).alias("status"), F.col("r.value").alias("answer"), "r.error")


@query(f"WITH {DUCK_QDENSE}, {DUCK_BM25}, {DUCK_RRF.replace('rk <= 8', 'rk <= 10')}, {DUCK_RERANK.replace('rk <= 4', 'rk <= 6')} SELECT qid, cid, rk FROM rr")
def bypass_retrieval(spark, sf_dir):
    return plans.bypass(*hybrid_tables(spark, sf_dir)).select("qid", "cid", F.col("rk").cast("long").alias("rk"))


@query(f"""WITH {DUCK_QDENSE}, {DUCK_BM25}, {DUCK_RRF}, {DUCK_RERANK}, g AS (SELECT qid, min(d) AS m FROM qd GROUP BY qid)
 SELECT b.item_id AS qid, CASE WHEN m <= 1.35 THEN md5(d.text) END AS digest FROM benchmark b JOIN g ON g.qid = b.item_id LEFT JOIN rr ON rr.qid = b.item_id AND m <= 1.35 AND rr.rk = 1 LEFT JOIN documents d ON d.doc_id = rr.cid""")
def top_context(spark, sf_dir):
    """Retrieval for prompts of one context."""
    return plans.retrieve(*hybrid_tables(spark, sf_dir), final=1).select("qid", F.md5("text").alias("digest"))


@query("SELECT * FROM (VALUES (11, 'yes'), (12, 'no'), (13, NULL), (14, 'yes'), (15, NULL), (16, NULL)) t(id, decision)")
def review_decisions(spark, sf_dir):
    queue = rows_of(spark, "id int, place int", [(10 + i, i) for i in range(1, 7)])
    return reports.reviewed(queue, rows_of(spark, "no int, key string", [(1, "y"), (2, " N "), (3, "s"), (4, "Y"), (5, "q"), (6, "y")]))


# Sources and sinks -----------------------------------------------------------------------------


def lines(spark: SparkSession, path: str, rows: list[str]) -> str:
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.mode("append").text(path)
    return path


RECORDS = ['{"id": 1, "question": "What?", "label": "easy"}', "", "{broken", '{"id": 2, "question": " ", "label": "hard"}', '{"id": 3, "question": "Why?", "label": "odd"}', '{"id": 4, "question": "Who?", "label": "hard"}']


@query("SELECT item_id, text FROM benchmark")
def jsonl_round_trip(spark, sf_dir):
    path = lineage.scratch(spark, "jsonl")
    sources.write_jsonl(read(spark, sf_dir, "benchmark"), path)
    return sources.jsonl(spark, path, "item_id long, text string", "fail")


@query("SELECT * FROM (VALUES (1, 'What?'), (2, ' '), (3, 'Why?'), (4, 'Who?')) t(id, question)")
def jsonl_dropped(spark, sf_dir):
    return sources.jsonl(spark, lines(spark, lineage.scratch(spark, "jsonl"), RECORDS), "id int, question string")


@query("SELECT 1 AS bad, '{broken' AS raw, 4 AS good")
def jsonl_audited(spark, sf_dir):
    rows = lineage.cut(sources.jsonl(spark, lines(spark, lineage.scratch(spark, "jsonl"), RECORDS), "id int, question string", "audit"))
    return rows.agg(F.count(sources.CORRUPT).cast("int").alias("bad"), F.max(sources.CORRUPT).alias("raw"), F.count("id").cast("int").alias("good"))


@query("SELECT * FROM (VALUES (3, 'not JSON'), (4, 'lacks question'), (5, 'unknown label')) t(line, reason)")
def jsonl_bad_lines(spark, sf_dir):
    path = lines(spark, lineage.scratch(spark, "jsonl"), RECORDS)
    return sources.bad_lines(spark, path, ["id", "question"], "label", ["easy", "hard"]).select("line", "reason")


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE text NOT LIKE '%' || chr(13) || '%'")
def csv_round_trip(spark, sf_dir):
    path = lineage.scratch(spark, "csv")
    docs = read(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\r")))
    sources.write_csv(docs.select("doc_id", "text", "lang"), path)
    return sources.csv(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT * FROM (VALUES ('What?'), ('Who?')) t(question)")
def csv_discovered(spark, sf_dir):
    """A byte order mark, and the question under one of several names."""
    rows = sources.csv(spark, lines(spark, lineage.scratch(spark, "csv"), ["\ufeffno,Question,answer", "1,What?,x", '2,Who?,"y, z"']))
    return rows.select(sources.first_of(rows, ["question", "text", "Question"]).alias("question"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(id, name)")
def json_array(spark, sf_dir):
    return sources.json_document(spark, lines(spark, lineage.scratch(spark, "json"), ["[", '  {"id": 1, "name": "a"},', '  {"id": 2, "name": "b"}', "]"]), "id int, name string")


@query("SELECT * FROM (VALUES ('law', 'a.png,b.png'), ('tax', '')) t(key, names)")
def json_mapping(spark, sf_dir):
    rows = sources.json_map(spark, lines(spark, lineage.scratch(spark, "json"), ['{"law": ["a.png", "b.png"],', ' "tax": []}']), "array<string>")
    return rows.select("key", F.array_join("value", ",").alias("names"))


@query("SELECT * FROM (VALUES ('one?', '.txt'), ('two?', '.txt')) t(question, suffix)".replace("'.txt'", "'.jsonl'", 1).replace("'.txt'", "'.csv'"))
def recursive_scan(spark, sf_dir):
    """Questions of JSON lines and CSV below a folder, without the excluded part."""
    top = lineage.scratch(spark, "scan")
    for folder, suffix, text in (("a", ".jsonl", ['{"question": "one?"}']), ("b/c", ".csv", ["question", "two?"]), ("skip/d", ".csv", ["question", "three?"])):
        renamed(spark, lines(spark, f"{top}/{folder}", text), suffix)
    rows = sources.recursive(spark, top, "/skip/")
    return rows.select("question", F.regexp_extract("file", "([.][a-z]+)$", 1).alias("suffix"))


def renamed(spark: SparkSession, folder: str, suffix: str) -> None:
    """The text files of a folder under another suffix."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for x in fs.listStatus(at(folder)):
        name = x.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(x.getPath(), at(f"{folder}/{name[:-4]}{suffix}"))


@query("SELECT * FROM (VALUES ('law', 2, 14), ('tax', 1, 3)) t(category, n, bytes)")
def image_folders(spark, sf_dir):
    top = lineage.scratch(spark, "images")
    for category, texts in (("law", ["abcdef", "ghijkl"]), ("tax", ["mn"])):
        for x in texts:
            lines(spark, f"{top}/{category}", [x])
        renamed(spark, f"{top}/{category}", ".png")
    files = sources.images(spark, top)
    return sources.manifest(files).select("category", F.size("paths").alias("n")).join(files.groupBy("category").agg(F.sum("length").cast("int").alias("bytes")), "category")


@query("SELECT conv_id, turn AS page, text FROM conversations WHERE trim(text) <> '' AND conv_id < 5")
def paged_documents(spark, sf_dir):
    """Binary documents of several pages; form feeds stand for an extractor."""
    some = read(spark, sf_dir, "conversations").where("conv_id < 5")
    top = lineage.scratch(spark, "pages")
    whole = sources.whole_documents(some.withColumn("line", F.coalesce("text", F.lit(""))), ["conv_id"], "turn", "line", "\f")
    whole.select(F.concat_ws("\f", F.col("conv_id").cast("string"), "text").alias("value")).repartition(5).write.option("lineSep", "\f").text(top)
    rows = sources.paged(spark, top, lambda b: b.decode().split("\f"), ".txt")
    first = rows.groupBy("source").agg(F.min_by("text", "page").alias("conv_id"))
    return rows.where("page > 1").join(first, "source").select(F.col("conv_id").cast("long").alias("conv_id"), (F.col("page") - 2).cast("long").alias("page"), "text")


@query("SELECT 'fallback' AS read, 3 AS n UNION ALL SELECT 'there', 5")
def fallback_source(spark, sf_dir):
    path = lineage.scratch(spark, "there")
    spark.range(5).write.parquet(path)
    count = lambda name, p: sources.or_else(spark, p, spark.read.parquet, lambda: spark.range(3)).agg(F.lit(name).alias("read"), F.count(F.lit(1)).cast("int").alias("n"))
    return count("fallback", f"{path}-none").unionByName(count("there", path))


@query("SELECT 'new' AS state, 4 AS n UNION ALL SELECT 'backup', 7 UNION ALL SELECT 'refused', 1")
def replaced_table(spark, sf_dir):
    """A folder that is written once, replaced in one step with its old state kept, and not written over."""
    path = lineage.scratch(spark, "table")
    sources.write_new(spark.range(7), path)
    old = sources.replace(spark.range(4), path, backup=True)
    try:
        sources.write_new(spark.range(1), path)
        refused = 0
    except Exception as error:
        refused = int("exist" in str(error).lower())
    count = lambda p: spark.read.parquet(p).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return count(path).select(F.lit("new").alias("state"), "n").unionByName(count(old).select(F.lit("backup").alias("state"), "n")).unionByName(rows_of(spark, "state string, n int", [("refused", refused)]))


@query("SELECT '# ' || upper(r_name) || ' (' || count(*) || ')' AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def text_report(spark, sf_dir):
    per = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    path = lineage.scratch(spark, "report")
    sources.write_lines(per, path, F.concat(F.lit("# "), F.upper("r_name"), F.lit(" ("), "n", F.lit(")")))
    return spark.read.text(path)


@query("SELECT * FROM (VALUES (0.5, 10), (0.75, 20)) t(accuracy, n)")
def metric_files(spark, sf_dir):
    top = lineage.scratch(spark, "metrics")
    for i, text in enumerate(['{"accuracy": 0.5, "n": 10}', "not JSON", '{"accuracy": 0.75,\n "n": 20}']):
        lines(spark, f"{top}/run{i}", [text])
    return sources.metrics(spark, f"{top}/run*", "accuracy double, n int").select("accuracy", "n")


@query(f"WITH {DUCK_BM25} SELECT qid, cid, rk FROM bm25 WHERE rk <= 3")
def bm25_index(spark, sf_dir):
    """The index written, over an older one, and read again."""
    path = lineage.scratch(spark, "bm25")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text")
    retrieval.Bm25.build(docs.limit(10)).write(path)
    retrieval.Bm25.build(docs).write(path)
    hits = retrieval.Bm25.read(spark, path).search(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), 3)
    return hits.select("qid", "cid", F.col("rk").cast("long").alias("rk"))
