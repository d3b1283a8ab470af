"""Queries on saved answers, prompts, contexts, the refusal gate and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lineage import cut
from tessera.operators import answers as A
from tessera.operators import bm25, sharded_search
from tessera.operators.contexts import context_docs, prompt_records, sampled_docs, share, shown_hits, subsample, train_val
from tessera.operators.judge import open_verdicts
from tessera.operators.ranking import overlap
from tessera.plans.registry import Registry
from tessera.plans.retrieval_queries import _BM25, _articles, _asked, _docs, _gold
from tessera.plans.sql_parts import ARTICLES, GOLD, PASSAGES
from tessera.plans.sql_parts import citation as citation_sql
from tessera.plans.sql_parts import strip as strip_sql
from tessera.plans.sql_parts import words as words_sql
from tessera.sources.stores import unfinished, with_cache
from tessera.sources.tables import table

R = Registry()

_CLEAN = strip_sql("regexp_replace(coalesce(answer, ''), '(?s)<think>.*?</think>', '', 'g')")
_ANSWERS = f"""answers AS (
  SELECT line_no, id, model, latency_ms, context, n_docs, coalesce(gold, []) AS gold, answer, {_CLEAN} AS clean FROM generations
), marks AS (
  SELECT *, list_transform(regexp_extract_all(clean, '\\[([0-9]+)\\]', 1), lambda d: try_cast(d AS integer)) AS found FROM answers
), first_use AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS cited FROM marks),
scored AS (
  SELECT *, list_filter(cited, lambda x: x BETWEEN 1 AND n_docs) AS valid, contains(lower(clean), 'không tìm thấy căn cứ') AS refused, len(gold) > 0 AS answerable,
    len(list_filter(cited, lambda x: coalesce(x NOT BETWEEN 1 AND n_docs, true))) > 0 AS invalid_cite
  FROM first_use
), rows AS (
  SELECT *, NOT refused AND len(valid) = 0 AS uncited, len(list_intersect(valid, gold)) > 0 AS cites_gold,
    len(list_intersect(valid, gold)) / nullif(len(valid), 0)::double AS cite_precision
  FROM scored
)"""


def _saved(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generations")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return A.scored(_saved(spark, folder))


@R.add(f"WITH {_ANSWERS} SELECT line_no, clean, refused FROM rows")
def clean_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers without reasoning blocks, and whether they refuse."""
    clean = T.clean_answer(F.coalesce("answer", F.lit("")))
    return _saved(spark, folder).select("line_no", clean.alias("clean"), T.is_refusal(clean).alias("refused"))


@R.add(f"WITH {_ANSWERS} SELECT line_no, array_to_string(valid, ',') AS valid, array_to_string(list_filter(cited, lambda x: coalesce(x NOT BETWEEN 1 AND n_docs, true)), ',') AS invalid FROM rows")
def parse_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Valid and invalid citations of each answer in order of first use."""
    answer = T.clean_answer(F.coalesce("answer", F.lit("")))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _saved(spark, folder).select("line_no", join(T.valid_citations(answer, F.col("n_docs"))).alias("valid"), join(T.invalid_citations(answer, F.col("n_docs"))).alias("invalid"))


_SCORE_COLUMNS = ["line_no", "answerable", "refused", "invalid_cite", "uncited", "cites_gold", "cite_precision"]


@R.add(f"WITH {_ANSWERS} SELECT line_no, answerable, refused, invalid_cite, uncited, cites_gold, round(cite_precision, 6) AS cite_precision FROM rows")
def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The marks of each saved answer."""
    return _scored(spark, folder).select(*_SCORE_COLUMNS[:-1], F.round("cite_precision", 6).alias("cite_precision"))


_SUMMARY = """count(*) AS n, count(*) FILTER (WHERE answerable) AS n_answerable, count(*) FILTER (WHERE NOT answerable) AS n_negative,
  round(avg((NOT refused)::int) FILTER (WHERE answerable), 4) AS answer_rate, round(avg(cites_gold::int) FILTER (WHERE answerable), 4) AS gold_cite_rate,
  round(avg(cite_precision) FILTER (WHERE NOT refused), 4) AS cite_precision, round(avg(invalid_cite::int) FILTER (WHERE NOT refused), 4) AS invalid_cite_rate,
  round(avg(uncited::int) FILTER (WHERE NOT refused), 4) AS uncited_rate, round(avg(refused::int) FILTER (WHERE NOT answerable), 4) AS refusal_acc,
  round(avg(latency_ms), 4) AS latency_ms"""


@R.add(f"WITH {_ANSWERS} SELECT model, {_SUMMARY} FROM rows GROUP BY model")
def summarize_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of each model, each over its own rows."""
    return A.summary(_scored(spark, folder), ["model"])


@R.add(f"WITH {_ANSWERS} SELECT line_no, model, CASE WHEN answerable THEN 'gold not cited' ELSE 'answered without gold' END AS error FROM rows WHERE (answerable AND NOT cites_gold) OR (NOT answerable AND NOT refused)")
def error_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that went wrong, by kind."""
    wrong = (F.col("answerable") & ~F.col("cites_gold")) | (~F.col("answerable") & ~F.col("refused"))
    kind = F.when(F.col("answerable"), "gold not cited").otherwise("answered without gold")
    return _scored(spark, folder).where(wrong).select("line_no", "model", kind.alias("error"))


# Prompts

_Q = strip_sql("string_split(context, chr(10) || chr(10) || 'CÂU HỎI: ')[-1]")


@R.add(f"SELECT line_no, CASE WHEN starts_with(context, 'NGỮ CẢNH:' || chr(10)) AND contains(context, chr(10) || chr(10) || 'CÂU HỎI: ') THEN {_Q} END AS question FROM generations")
def prompt_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The question in each saved prompt."""
    return _saved(spark, folder).select("line_no", T.message_question(F.col("context")).alias("question"))


@R.add(
    f"""WITH RECURSIVE {PASSAGES} SELECT line_no, place, passage FROM passages
UNION ALL SELECT line_no, NULL, NULL FROM generations WHERE line_no NOT IN (SELECT line_no FROM passages)"""
)
def prompt_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The numbered passages of each saved prompt."""
    return _saved(spark, folder).select("line_no", F.posexplode_outer(T.message_passages(F.col("context"), F.col("n_docs"))).alias("place", "passage"))


@R.add("SELECT line_no, substring(md5(context), 1, 12) AS digest FROM generations")
def context_digest(spark: SparkSession, folder: str) -> DataFrame:
    """A short digest of each saved prompt, the key of the score cache."""
    return _saved(spark, folder).select("line_no", F.substring(F.md5("context"), 1, 12).alias("digest"))


_HTML = f"""{_CLEAN}"""


@R.add(
    f"""SELECT line_no, replace(CASE WHEN n_docs > 0 THEN list_reduce(list_concat([e], list_transform(range(1, n_docs + 1), lambda i: CAST(i AS varchar))),
    lambda t, i: regexp_replace(t, concat('\\[(0*', i, ')\\]'), concat('<a href="#source-', i, '">[\\1]</a>'), 'g')) ELSE e END, chr(10), '<br>') AS html
FROM (SELECT line_no, n_docs, replace(replace(replace(replace(replace({_HTML}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS e FROM generations)"""
)
def render_answer_html(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as HTML with anchors on citations."""
    clean = T.clean_answer(F.coalesce("answer", F.lit("")))
    return _saved(spark, folder).select("line_no", T.answer_html(clean, F.col("n_docs")).alias("html"))


# Gate: the score of a saved prompt is the largest lexical overlap of its question with one of its passages

_GATE = f"""{PASSAGES}, asked_words AS (SELECT line_no, list_distinct({words_sql(_Q)}) AS a FROM generations),
shares AS (
  SELECT line_no, max(coalesce(len(list_intersect(a, d)) / nullif(len(a), 0)::double, 0)) AS most
  FROM (SELECT p.line_no, a, {words_sql("passage")} AS d FROM passages p JOIN asked_words w ON w.line_no = p.line_no) GROUP BY line_no
), gate AS (
  SELECT g.line_no, id, model, answer, n_docs, context, latency_ms, coalesce(gold, []) AS gold, len(coalesce(gold, [])) > 0 AS answerable, round(coalesce(most, 0), 4) AS score
  FROM generations g LEFT JOIN shares o ON o.line_no = g.line_no
), counts AS (SELECT score AS threshold, count(*) FILTER (WHERE answerable) AS pos, count(*) FILTER (WHERE NOT answerable) AS neg FROM gate GROUP BY score
  UNION ALL SELECT 0.0, 0, 0 UNION ALL SELECT 'infinity'::double, 0, 0),
once AS (SELECT threshold, sum(pos) AS pos, sum(neg) AS neg FROM counts GROUP BY threshold),
rated AS (SELECT threshold, sum(pos) OVER down / sum(pos) OVER () AS keep, 1 - sum(neg) OVER down / sum(neg) OVER () AS block FROM once WINDOW down AS (ORDER BY threshold DESC)),
points AS (SELECT threshold, round(keep, 6) AS keep_answerable, round(block, 6) AS block_negative, round((keep + block) / 2, 6) AS balanced_accuracy FROM rated)"""


def _gate_rows(spark: SparkSession, folder: str) -> DataFrame:
    question = F.substring_index("context", T.QUESTION_MARK, -1)
    scores = F.transform(T.message_passages(F.col("context"), F.col("n_docs")), lambda passage: overlap(question, passage))
    score = F.round(F.coalesce(F.array_max(scores), F.lit(0.0)), 4)
    return _saved(spark, folder).withColumns({"score": score, "answerable": F.coalesce(F.size("gold"), F.lit(0)) > 0})


@R.add(f"WITH RECURSIVE {_GATE} SELECT threshold, keep_answerable, block_negative, balanced_accuracy FROM points")
def gate_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and blocked shares at every threshold."""
    return A.gate_sweep(_gate_rows(spark, folder))


@R.add(f"WITH RECURSIVE {_GATE} SELECT * FROM points ORDER BY balanced_accuracy DESC, threshold LIMIT 1")
def gate_choose_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """The threshold of best balanced accuracy."""
    return A.choose_threshold(gate_sweep(spark, folder))


@R.add(f"WITH RECURSIVE {_GATE} SELECT * FROM points WHERE keep_answerable >= 0.9 ORDER BY block_negative DESC, threshold LIMIT 1")
def gate_choose_min_keep(spark: SparkSession, folder: str) -> DataFrame:
    """The strictest threshold that keeps nine in ten answerable questions."""
    return A.choose_threshold(gate_sweep(spark, folder), 0.9)


_GATED_SQL = f"""WITH RECURSIVE {_GATE}, gated AS (SELECT *, score IS NULL OR score < 0.5 AS gated FROM gate)"""


@R.add(_GATED_SQL + " SELECT model, count(*) AS n, round(avg((NOT gated)::int) FILTER (WHERE answerable), 6) AS keep, round(avg(gated::int) FILTER (WHERE NOT answerable), 6) AS block FROM gated GROUP BY model")
def gate_test_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and blocked shares of each model at a given threshold."""
    rows = A.gated(_gate_rows(spark, folder), F.col("score"), 0.5)
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("answerable"), (~F.col("gated")).cast("double"))), 6).alias("keep"),
        F.round(F.avg(F.when(~F.col("answerable"), F.col("gated").cast("double"))), 6).alias("block"),
    )


@R.add(
    f"""WITH RECURSIVE {_GATE}, {_ANSWERS}, flags AS (SELECT line_no AS line, score < 0.5 AS gated FROM gate),
after AS (SELECT r.* REPLACE (r.refused OR gated AS refused, NOT (r.refused OR gated) AND NOT gated AND len(r.valid) = 0 AS uncited, r.cites_gold AND NOT gated AS cites_gold,
  r.invalid_cite AND NOT gated AS invalid_cite, CASE WHEN gated THEN NULL ELSE r.cite_precision END AS cite_precision) FROM rows r JOIN flags ON r.line_no = flags.line),
a AS (SELECT model, {_SUMMARY} FROM rows GROUP BY model), b AS (SELECT model, {_SUMMARY} FROM after GROUP BY model)
SELECT a.model, a.gold_cite_rate AS gold_cite_before, b.gold_cite_rate AS gold_cite_after, a.cite_precision AS precision_before, b.cite_precision AS precision_after,
  a.refusal_acc AS refusal_before, b.refusal_acc AS refusal_after FROM a JOIN b ON a.model IS NOT DISTINCT FROM b.model"""
)
def before_after_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each model's rates before and after the gate replaces answers under a threshold."""
    rows = _gate_rows(spark, folder)
    names = {"gold_cite_rate": "gold_cite", "cite_precision": "precision", "refusal_acc": "refusal"}
    side = lambda df, when: A.summary(A.scored(df), ["model"]).select("model", *(F.col(c).alias(f"{n}_{when}") for c, n in names.items()))
    before, after = side(rows, "before"), side(A.gated(rows, F.col("score"), 0.5), "after").withColumnRenamed("model", "m")
    columns = [f"{n}_{when}" for n in names.values() for when in ("before", "after")]
    return before.join(after, before["model"].eqNullSafe(after["m"])).select("model", *columns)


# Contexts and sampling


_SHOWN_DOCS = f""", shown_docs AS (
  SELECT query, doc, rank, {citation_sql('doc', 'title')} AS citation, CASE WHEN length(whole) <= 1500 THEN whole ELSE substring(text, 1, 1500) END AS text
  FROM (SELECT u_ranked.query, u_ranked.doc, rank, docs.text, title, {strip_sql('docs.text')} AS whole
    FROM u_ranked JOIN docs ON docs.doc = u_ranked.doc JOIN articles a ON a.article_id = u_ranked.doc WHERE rank <= 3))"""


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return sharded_search.search_texts(_docs(spark, folder), _asked(spark, folder), 10)


@R.add(
    _BM25
    + _SHOWN_DOCS
    + " SELECT query, doc, rank, citation, text FROM shown_docs"
)
def context_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passage and citation of the three best articles of each question, whole articles searched: a long one gives its start."""
    hits = _pool(spark, folder).where("rank <= 3").join(_docs(spark, folder).select("doc", F.col("text").alias("hit_text")), "doc")
    return context_docs(hits.select("query", "doc", "rank", "hit_text"), _articles(spark, folder))


@R.add(
    _BM25 + _SHOWN_DOCS + f""" SELECT s.query, concat('NGỮ CẢNH:', chr(10), string_agg(concat('[', rank, '] (', citation, ')', chr(10), {strip_sql('s.text')}), chr(10) || chr(10) ORDER BY rank),
  chr(10), chr(10), 'CÂU HỎI: ', any_value({strip_sql('asked.text')})) AS message FROM shown_docs s JOIN asked ON asked.query = s.query GROUP BY s.query"""
)
def context_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The user turn with the numbered passages of each question."""
    docs = context_passages(spark, folder).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "citation", "text"))).alias("d"))
    return docs.join(_asked(spark, folder).withColumnRenamed("text", "asked"), "query").select("query", T.user_message(F.col("asked"), F.col("d")).alias("message"))


@R.add()
def context_passages_matched(spark: SparkSession, folder: str) -> DataFrame:
    """The same with chunks searched: a long article gives the chunk that matched."""
    known = _articles(spark, folder)
    return context_docs(sharded_search.search_articles(known, _asked(spark, folder), 3).select("query", "doc", "rank", "hit_text"), known)


def _shown(spark: SparkSession, folder: str, pool: DataFrame) -> DataFrame:
    known, asked = _articles(spark, folder), _asked(spark, folder)
    gold = _gold(spark, folder).select(F.col("query_id").alias("query"), F.col("article_id").alias("doc"))
    gold = gold.join(asked.select("query"), "query", "left_semi").join(known.select(F.col("article_id").alias("doc")), "doc", "left_semi")
    return sampled_docs(gold, pool)


_SHOWN = (
    _BM25
    + f""", {GOLD}, relevant AS (
  SELECT DISTINCT query_id AS query, article_id AS doc FROM gold WHERE query_id IN (SELECT query FROM asked) AND article_id IN (SELECT article_id FROM articles)
), chosen AS (
  SELECT query, least(count(*), 3) AS n_gold,
    CASE WHEN CAST('0x' || substring(md5('13-' || query), 1, 7) AS bigint) / 268435456.0 < 0.15 THEN 'negative' ELSE 'answerable' END AS kind FROM relevant GROUP BY query
), negatives AS (
  SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY rank) AS n FROM u_ranked r WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM relevant g WHERE g.query = r.query AND g.doc = r.doc)
), rights AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY doc) AS n FROM relevant),
both_kinds AS (
  SELECT query, kind, doc, n AS base, true AS is_gold FROM rights JOIN chosen USING (query) WHERE n <= 3 AND kind = 'answerable'
  UNION ALL SELECT query, kind, doc, n, false FROM negatives JOIN chosen USING (query) WHERE n <= CASE WHEN kind = 'negative' THEN 3 ELSE 3 - n_gold END
), shown AS (
  SELECT query, kind, doc, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN kind = 'negative' THEN lpad(base::varchar, 9, '0') ELSE md5('13-' || query || '-' || doc) END, doc) AS place, is_gold FROM both_kinds
)"""
)


@R.add(_SHOWN + " SELECT query, kind, doc, place, is_gold FROM shown")
def oracle_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The articles each judged question of the query set is shown: gold and hard negatives, or negatives only."""
    return _shown(spark, folder, _pool(spark, folder))


@R.add()
def sft_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt records of the same questions, drawn from the ten best articles by their best chunk."""
    known = _articles(spark, folder)
    pool = cut(sharded_search.search_articles(known, _asked(spark, folder), 10))
    shown = cut(_shown(spark, folder, pool))
    return prompt_records(shown, context_docs(shown_hits(shown, pool, _docs(spark, folder)), known), _asked(spark, folder))


_SFT = """raw AS (SELECT line_no, id, type, n_docs, coalesce(gold, []) AS gold, list_filter(completion, lambda m: m.role = 'assistant')[-1].content AS answer FROM sft_raw),
parts AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(coalesce(answer, ''), '(?s)<think>.*?</think>', '', 'g'), '\\[([0-9]+)\\]', 1), lambda d: try_cast(d AS integer)) AS cited FROM raw),
accepted AS (
  SELECT line_no, id, type FROM parts WHERE type = 'negative' OR (
    NOT contains(lower(regexp_replace(coalesce(answer, ''), '(?s)<think>.*?</think>', '', 'g')), 'không tìm thấy căn cứ')
    AND len(list_filter(cited, lambda x: coalesce(x NOT BETWEEN 1 AND n_docs, true))) = 0 AND len(list_intersect(cited, gold)) > 0)
)"""


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.try_element_at(F.filter("completion", lambda m: m["role"] == "assistant"), F.lit(-1))["content"]
    rows = A.scored(table(spark, folder, "sft_raw").withColumn("answer", reply))
    good = ~F.col("refused") & ~F.col("invalid_cite") & F.col("cites_gold")
    return rows.where((F.col("type") == "negative") | good)


@R.add(f"WITH {_SFT} SELECT line_no, id, type FROM accepted")
def sft_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Training pairs that are kept: negatives, and answers that cite gold and nothing else."""
    return _accepted(spark, folder).select("line_no", "id", "type")


@R.add(f"WITH {_SFT} SELECT type, count(*) AS n FROM accepted GROUP BY type")
def sft_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Kept pairs by kind."""
    return _accepted(spark, folder).groupBy("type").agg(F.count("*").alias("n"))


@R.add("SELECT line_no, CASE WHEN row_number() OVER (ORDER BY md5('0-' || line_no), line_no) <= greatest(1, floor(count(*) OVER () * 0.05)) THEN 'val' ELSE 'train' END AS part FROM sft_raw")
def train_val_split(spark: SparkSession, folder: str) -> DataFrame:
    """An exact share of the pairs for validation, by a hash."""
    return train_val(table(spark, folder, "sft_raw").select("line_no"), "line_no", 0.05)


@R.add(
    f"""WITH {ARTICLES}, {GOLD}, kept AS (SELECT article_id FROM articles WHERE article_id IN (SELECT article_id FROM gold WHERE split = 'test')),
rest AS (SELECT article_id, row_number() OVER (ORDER BY md5('0-' || article_id), article_id) AS n FROM articles WHERE article_id NOT IN (SELECT article_id FROM gold WHERE split = 'test'))
SELECT article_id FROM kept UNION ALL SELECT article_id FROM rest WHERE n <= greatest(200 - (SELECT count(*) FROM kept), 0)"""
)
def subsample_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All gold articles of the test split, filled up to 200 with others."""
    keep = _gold(spark, folder).where("split = 'test'").select("article_id")
    return subsample(_articles(spark, folder), keep, 200).select("article_id")


@R.add(f"WITH {GOLD} SELECT DISTINCT query_id, CAST('0x' || substring(md5('7-' || query_id), 1, 7) AS bigint) / 268435456.0::double < 0.2 AS negative FROM gold WHERE split = 'train' AND query_id NOT IN (SELECT id FROM sft_raw WHERE id IS NOT NULL)")
def gate_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Training questions that no training pair was made of, each with whether it gets negatives only."""
    rows = _gold(spark, folder).where("split = 'train'").select("query_id").distinct()
    return rows.join(table(spark, folder, "sft_raw").select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", (share(7, "query_id") < 0.2).alias("negative"))


@R.add(f"WITH {GOLD} SELECT DISTINCT query_id FROM gold WHERE split = 'train' AND query_id NOT IN (SELECT id FROM generations WHERE id IS NOT NULL)")
def resume_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of a split that have no saved answer yet."""
    rows = _gold(spark, folder).where("split = 'train'").select("query_id").distinct()
    return unfinished(rows, _saved(spark, folder).select(F.col("id").alias("query_id")), "query_id")


@R.add("""SELECT g.line_no, s.line_no IS NOT NULL AS cached FROM generations g
LEFT JOIN (SELECT id, md5(list_filter(prompt, lambda m: m.role = 'user')[-1].content) AS digest, min(line_no) AS line_no FROM sft_raw GROUP BY 1, 2) s ON s.id = g.id AND s.digest = md5(g.context)""")
def score_cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Saved answers whose very prompt was scored before."""
    user = F.try_element_at(F.filter("prompt", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    cache = table(spark, folder, "sft_raw").select("id", F.md5(user).alias("digest"), "line_no")
    work = _saved(spark, folder).select(F.col("line_no").alias("row"), "id", F.md5("context").alias("digest"))
    known, missing = with_cache(work, cache, ["id", "digest"], "line_no")
    return known.select(F.col("row").alias("line_no"), F.lit(True).alias("cached")).union(missing.select("row", F.lit(False)))


@R.add(f"WITH {_ANSWERS} SELECT line_no AS id FROM rows WHERE NOT refused AND line_no % 3 <> 0")
def judge_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """Answers a judge has yet to see: those that do not refuse and have no verdict in a log, here of every third row, and of others without one."""
    log = _saved(spark, folder).where("line_no % 3 < 2").select(F.col("line_no").alias("id"), F.when(F.expr("line_no % 3 = 0"), True).alias("faithful"))
    return open_verdicts(_scored(spark, folder).withColumn("id", F.col("line_no")), log).select("id")


@R.add(
    f"""WITH {_ANSWERS}, replies AS (SELECT line_no, CASE WHEN cites_gold THEN '{{"faithful": true}}' WHEN len(valid) > 0 THEN concat('verdict: {{"faithful": false, "reason": "', model, '"}}.') ELSE answer END AS reply FROM rows)
SELECT line_no, CASE WHEN raw IS NOT NULL THEN raw NOT IN ('false', '0', '0.0', '', 'null', '[]', '{{}}') END AS faithful
FROM (SELECT line_no, CASE WHEN json_valid(regexp_extract(reply, '(?s)\\{{.*\\}}', 0)) THEN json_extract_string(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), '$.faithful') END AS raw FROM replies)"""
)
def judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts read from judge replies that are made of the saved answers."""
    reply = (
        F.when(F.col("cites_gold"), '{"faithful": true}')
        .when(F.size("cited") > 0, F.concat(F.lit('verdict: {"faithful": false, "reason": "'), F.col("model"), F.lit('"}.')))
        .otherwise(F.col("answer"))
    )
    return _scored(spark, folder).select("line_no", T.verdict(reply).alias("faithful"))


@R.add("SELECT line_no, round(latency_ms, 1) AS latency_ms, round(latency_ms / 1000, 1) AS latency_s FROM generations")
def timings_round(spark: SparkSession, folder: str) -> DataFrame:
    """Timings to one decimal."""
    timings = F.transform_values(F.create_map(F.lit("latency_ms"), F.col("latency_ms"), F.lit("latency_s"), F.col("latency_ms") / 1000), lambda _, v: F.round(v, 1))
    rows = _saved(spark, folder).select("line_no", timings.alias("m"))
    return rows.select("line_no", F.col("m")["latency_ms"].alias("latency_ms"), F.col("m")["latency_s"].alias("latency_s"))


@R.add("SELECT model, line_no AS fastest, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_ms, line_no) AS n FROM generations WHERE latency_ms IS NOT NULL) WHERE n = 1")
def best_row(spark: SparkSession, folder: str) -> DataFrame:
    """The row of least latency of each model (as the best checkpoint of a history)."""
    rows = _saved(spark, folder).where("latency_ms is not null")
    return rows.groupBy("model").agg(F.min(F.struct("latency_ms", "line_no")).alias("best")).select("model", F.col("best.line_no").alias("fastest"), F.col("best.latency_ms").alias("latency_ms"))
