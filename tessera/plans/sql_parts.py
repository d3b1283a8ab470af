"""Common table expressions that the SQL of several queries shares."""

WORDS = "regexp_extract_all(lower(nfc_normalize({})), '[\\p{{L}}\\p{{N}}_]+')"


def words(text: str) -> str:
    return WORDS.format(text)


#: White space of any script, a fixed value (the Unicode property).
SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def citation(doc: str, title: str) -> str:
    head = strip(f"split_part({title}, '.', 1)")
    label = f"CASE WHEN starts_with(lower({head}), 'điều') THEN {head} ELSE concat('Điều ', string_split({doc}, '+')[-1]) END"
    return f"concat({label}, ', ', upper(regexp_extract({doc}, '(?s)^(.*)\\+', 1)))"


#: The passages of saved prompts: each starts at the first mark after the one before it.
PASSAGES = """bodies AS (
  SELECT line_no, n_docs, concat(chr(10), chr(10), regexp_extract(context, '(?s)^NGỮ CẢNH:' || chr(10) || '(.*)' || chr(10) || chr(10) || 'CÂU HỎI: ', 1)) AS body,
    starts_with(context, 'NGỮ CẢNH:' || chr(10)) AND contains(context, chr(10) || chr(10) || 'CÂU HỎI: ') AS whole FROM generations
), starts AS (
  SELECT line_no, n_docs, body, 0 AS i, 0::bigint AS pos FROM bodies WHERE whole
  UNION ALL
  SELECT line_no, n_docs, body, i + 1, CASE WHEN p > 0 THEN pos + p END
  FROM (SELECT *, strpos(substr(body, pos + 1), concat(chr(10), chr(10), '[', i + 1, '] (')) AS p FROM starts WHERE i < n_docs AND pos IS NOT NULL)
), blocks AS (
  SELECT line_no, i, substr(body, pos + 2, coalesce(lead(pos) OVER (PARTITION BY line_no ORDER BY i), length(body) + 1) - pos - 2) AS block,
    count(pos) OVER (PARTITION BY line_no) = n_docs + 1 AS complete FROM starts
), passages AS (
  SELECT line_no, i - 1 AS place, CASE WHEN contains(block, chr(10)) THEN regexp_replace(block, '^[^\n]*\n', '') ELSE '' END AS passage
  FROM blocks WHERE i > 0 AND complete
)"""


def vectors(name: str, docs: str, prefix: str) -> str:
    """Hashed vectors at length one of ``docs`` (doc, text), as rows of a place and a value."""
    return f"""
{name}_words AS (SELECT doc, unnest({words("concat('" + prefix + "', text)")}) AS w FROM {docs}),
{name}_places AS (
  SELECT doc, CAST('0x' || substring(md5(w), 1, 7) AS bigint) % 64 AS place, sum(CASE WHEN substring(md5(w), 8, 1) < '8' THEN 1 ELSE -1 END) AS v FROM {name}_words GROUP BY 1, 2
),
{name}_unit AS (SELECT doc, place, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY doc)), 0)::double AS x FROM {name}_places)"""


ARTICLES = """articles AS (
  SELECT _id AS article_id, coalesce(title, '') AS title, coalesce(text, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY line_no DESC) AS newest FROM corpus WHERE _id IS NOT NULL) WHERE newest = 1
)"""
QUESTIONS = """questions AS (
  SELECT _id AS query_id, coalesce(text, '') AS text, line_no
  FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY line_no DESC) AS newest FROM queries WHERE _id IS NOT NULL) WHERE newest = 1
)"""
GOLD = """gold AS (
  SELECT DISTINCT split, "query-id" AS query_id, "corpus-id" AS article_id FROM qrels
  WHERE coalesce(score, 1.0) > 0 AND "query-id" IS NOT NULL AND "corpus-id" IS NOT NULL
)"""
ASKED = "asked AS (SELECT query_id AS query, text FROM questions WHERE line_no % 50 = 0)"
ARTICLE_DOCS = "docs AS (SELECT article_id AS doc, concat(title, chr(10), text) AS text FROM articles)"
CHUNK_DOCS = """docs AS (
  SELECT id AS doc, article_id, coalesce(text, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) AS newest FROM chunks WHERE id IS NOT NULL) WHERE newest = 1
)"""


def bm25(name: str, bigrams: bool = False, docs: str = "docs") -> str:
    """weights and scores of BM25 over ``docs`` for ``asked``; names are prefixed by ``name``."""
    two = "list_concat({0}, list_transform(range(1, greatest(len({0}), 1)), lambda i: concat({0}[i], '_', {0}[i + 1])))"
    tokens = two.format("t") if bigrams else "t"
    return f"""
{name}_tokens AS (SELECT doc, {tokens} AS t FROM (SELECT doc, {words('text')} AS t FROM {docs})),
{name}_stats AS (SELECT count(*) AS n_docs, greatest(avg(len(t)), 1e-9) AS avg_len FROM {name}_tokens),
{name}_tf AS (SELECT doc, n, term, count(*) AS tf FROM (SELECT doc, len(t) AS n, unnest(t) AS term FROM {name}_tokens) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_weights AS (
  SELECT term, doc, tf, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len)) AS weight
  FROM {name}_tf JOIN {name}_df USING (term), {name}_stats
),
{name}_terms AS (SELECT DISTINCT query, unnest({tokens}) AS term FROM (SELECT query, {words('text')} AS t FROM asked)),
{name}_scores AS (
  SELECT query, doc, sum(CAST(round(weight, 9) AS decimal(20,9))) AS score FROM {name}_terms JOIN {name}_weights USING (term) GROUP BY query, doc
),
{name}_ranked AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {name}_scores)"""
