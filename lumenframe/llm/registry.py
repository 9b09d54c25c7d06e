"""The corpus queries, and the SQL that an oracle engine can run for some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import divergence, extract, hamming, language, lines, mixing, near, ogg, packing, phrases, repeats, slack, toxicity
from lumenframe.llm.shared import bounded, crc_mod, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels of the held-out fifth are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; the held-out quarter is not learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held))
    found = docs.select("doc_id", held.alias("held_out"), language.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def tokenizer_files() -> tuple[str, str, str]:
    """The tokenizer file of the packing query, its ranks, and the pattern that both share."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_files()).withColumnRenamed("id", "doc_id")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after its site's boilerplate lines are dropped; documents have no URL, their source is the site."""
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents"), count_col="n_dropped")
    return kept.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLES["op9_line_dedup"] = f"""
WITH page AS (
  SELECT row_number() OVER () AS page, source, text FROM (SELECT DISTINCT source, text FROM documents)
), each AS (
  SELECT page, source, unnest(list_filter(list_distinct(string_split(text, chr(10))), lambda x: x <> '')) AS line FROM page
), candidate AS (
  SELECT l.source, l.line
  FROM (SELECT source, line, count(*) AS n FROM each GROUP BY source, line) AS l
  JOIN (SELECT source, count(*) AS pages FROM page GROUP BY source) AS p ON p.source IS NOT DISTINCT FROM l.source
  WHERE l.n >= {lines.MIN_PAGES} AND l.n > {lines.RATIO} * p.pages
), sized AS (
  SELECT e.page, sum(length(e.line)) AS n, sum(CASE WHEN c.line IS NULL THEN length(e.line) ELSE 0 END) AS own
  FROM each AS e LEFT JOIN candidate AS c ON c.source IS NOT DISTINCT FROM e.source AND c.line = e.line GROUP BY e.page
), counted AS (
  SELECT p.page, p.source FROM page AS p LEFT JOIN sized AS s ON s.page = p.page WHERE s.page IS NULL OR s.own >= {lines.OWN} * s.n
), often AS (
  SELECT l.source, l.line
  FROM (SELECT e.source, e.line, count(*) AS n FROM each AS e JOIN counted AS k ON k.page = e.page
        JOIN candidate AS c ON c.source IS NOT DISTINCT FROM e.source AND c.line = e.line GROUP BY e.source, e.line) AS l
  JOIN (SELECT source, count(*) AS pages FROM counted GROUP BY source) AS p ON p.source IS NOT DISTINCT FROM l.source
  WHERE l.n >= {lines.MIN_PAGES} AND l.n > {lines.RATIO} * p.pages
), split AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth FROM documents
), kept AS (
  SELECT s.doc_id, count(o.line) AS n_dropped,
    coalesce(string_agg(s.line, chr(10) ORDER BY s.nth) FILTER (WHERE o.line IS NULL), '') AS text
  FROM split AS s LEFT JOIN often AS o ON o.source IS NOT DISTINCT FROM s.source AND o.line = s.line
  GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped, CAST(length(k.text) AS BIGINT) AS n_kept_chars, md5(k.text) AS kept_md5
FROM documents AS d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near.near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op5_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes to every twentieth embedding, itself included."""
    vectors = table(spark, sf_dir, "embeddings")
    codes = vectors.select(F.col("vec_id").alias("id"), hamming.sign_code("embedding", hamming.longest(vectors, "embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("id % 20 = 0"), 10)


ORACLES["op5_hamming_search"] = """
WITH bits AS (
  SELECT vec_id AS id, string_agg(CASE WHEN x > 0 THEN '1' ELSE '0' END, '' ORDER BY pos) AS code
  FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
  GROUP BY vec_id
), pairs AS (
  SELECT q.id AS query_id, c.id, hamming(q.code, c.code) AS distance
  FROM (SELECT * FROM bits WHERE id % 20 = 0) AS q CROSS JOIN bits AS c
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""


@query
def op6_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg file, read back from its bytes."""
    bounded(spark)
    files = table(spark, sf_dir, "documents").select("doc_id", ogg.stored("text").alias("media"))
    return files.select("doc_id", ogg.inspected("media").alias("r")).select("doc_id", "r.*")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a smaller document has too, in strings of 50."""
    return repeats.drop_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into as few sequences of 2048 tokens as possible."""
    return slack.pack(table(spark, sf_dir, "documents"), tokenizer_files()).withColumnRenamed("id", "doc_id")


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firmest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, and its own terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_phrases"] = r"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), word AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece WHERE len(w) > 0
), f AS (
  SELECT lang, w[i : i + k - 1] AS g, k, count(*) AS n FROM word, (VALUES (1), (2), (3), (4)) AS v(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), total AS (
  SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT * FROM f WHERE k >= 2 AND n >= 30
), piled AS (
  SELECT c.lang, c.g[j : j + m - 1] AS g, max(c.n) AS most FROM candidate AS c, (VALUES (1), (2), (3)) AS s(j), (VALUES (2), (3)) AS z(m)
  WHERE m < c.k AND j + m - 1 <= c.k GROUP BY ALL
), left_over AS (
  SELECT c.* FROM candidate AS c LEFT JOIN piled AS p ON p.lang = c.lang AND p.g = c.g WHERE p.most IS NULL OR 100 * p.most < 80 * c.n
), cuts AS (
  SELECT lang, g, k, n, unnest(range(1, k)) AS j FROM left_over
), scored AS (
  SELECT c.lang, c.g, c.n AS a, l.n AS l, r.n AS r, CAST(CAST(2000000 AS HUGEINT) * c.n // (l.n + r.n) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.g ORDER BY CAST(2000000 AS HUGEINT) * c.n // (l.n + r.n), j) AS nth
  FROM cuts AS c JOIN f AS l ON l.lang = c.lang AND l.g = c.g[1 : j] JOIN f AS r ON r.lang = c.lang AND r.g = c.g[j + 1 : c.k]
), ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM scored WHERE nth = 1
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked AS r JOIN total AS t ON t.lang = r.lang WHERE r.rank <= 2000
"""


ORACLES["op13_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), each AS (
  SELECT doc, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM grp AS g JOIN kept AS k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM each GROUP BY ALL) AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT n.lang, n.source, n.term, n.n, 1 + CAST(1000000000 AS HUGEINT) * (n.n + 2) // (sum(n.n) OVER (PARTITION BY n.lang, n.source) + 2 * s.v) AS p
  FROM n JOIN sizes AS s ON s.lang = n.lang
), q AS (
  SELECT a.lang, a.term, 1 + CAST(1000000000 AS HUGEINT) * (a.n + 2) // (sum(a.n) OVER (PARTITION BY a.lang) + 2 * s.v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term) AS a JOIN sizes AS s ON s.lang = a.lang
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM grp AS a JOIN grp AS b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p AS x JOIN p AS y ON y.lang = x.lang AND y.term = x.term GROUP BY ALL) AS f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


ORACLES["op7_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), each AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM w
), size AS (
  SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM each AS a JOIN each AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size AS p ON p.doc_id = a.doc_id JOIN size AS q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 75 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(k, label) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.j, r.label FROM reach AS r JOIN link AS l ON l.i = r.k
), best AS (
  SELECT k, min(label) AS component_id FROM reach GROUP BY k
)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, b.component_id, b.component_id = d.doc_id AS kept
FROM documents AS d JOIN best AS b ON b.k = d.doc_id LEFT JOIN size AS z ON z.doc_id = d.doc_id
"""


ORACLES["op8_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), part AS (
  SELECT doc_id, "at", n, substring(h, 2 * "at" + 1, 610) AS h FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2, 256)) AS "at" FROM d)
), b AS (
  SELECT doc_id, "at" + j AS s, substring(h, 2 * j + 1, 2) AS byte, CASE WHEN "at" + j + 50 <= n THEN substring(h, 2 * j + 1, 100) END AS w
  FROM (SELECT doc_id, "at", n, h, unnest(range(least(256, n - "at"))) AS j FROM part)
), least_of AS (
  SELECT w, min(doc_id) AS lo FROM b WHERE w IS NOT NULL GROUP BY w
), hit AS (
  SELECT b.doc_id, b.s, b.byte, max(CASE WHEN l.lo < b.doc_id THEN b.s END) OVER (PARTITION BY b.doc_id ORDER BY b.s) AS last
  FROM b LEFT JOIN least_of AS l ON l.w = b.w
), marked AS (
  SELECT doc_id, s, byte, coalesce(s - last < 50, false) AS gone FROM hit
), edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS starts FROM marked
), found AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY s) FILTER (WHERE NOT gone), '') AS kept FROM edged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(f.n_bytes, 0) AS BIGINT) AS n_bytes, CAST(coalesce(f.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(f.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(f.kept, ''))) AS kept_sha256
FROM documents AS d LEFT JOIN found AS f ON f.doc_id = d.doc_id
"""


#: For pages without weak names and unmarked regions, as all pages of the given tables are: furniture is cut out by its
#: elements, what is left is the page's one region.
ORACLES["op2_html_text"] = r"""
WITH bare AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<head>.*</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
      '(?s)<nav>.*?</nav>', '', 'g'), '(?s)<div class="ad">.*?</div>', '', 'g'), '(?s)<footer>.*?</footer>', '', 'g') AS body FROM pages
), block AS (
  SELECT page_id, url, host, list_filter(list_transform(regexp_split_to_array(body, '</?(?:html|body|article|p|h1|br)(?: [^>]*)?>'),
    lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS bs FROM bare
), unit AS (
  SELECT row_number() OVER (ORDER BY host, bs) AS u, host, bs FROM (SELECT DISTINCT host, bs FROM block WHERE len(bs) > 0)
), stream AS (
  SELECT u, host, string_split(translate(array_to_string(bs, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ') AS w FROM unit
), gram AS (
  SELECT u, host, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT u, host, w, unnest(range(1, len(w) - 6)) AS i FROM stream WHERE len(w) >= 8)
), token AS (
  SELECT u, host, unnest(range(1, len(w) + 1)) AS i FROM stream
), twice AS (
  SELECT host, g FROM gram GROUP BY host, g HAVING count(DISTINCT u) >= 2
), hit AS (
  SELECT gram.u, gram.i FROM gram JOIN twice ON twice.host = gram.host AND twice.g = gram.g
), own AS (
  SELECT u, host FROM (SELECT t.u, t.host, t.i - max(h.i) OVER (PARTITION BY t.u ORDER BY t.i) < 8 AS gone FROM token AS t LEFT JOIN hit AS h ON h.u = t.u AND h.i = t.i)
  GROUP BY u, host HAVING 1 - avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END) >= 0.25
), least AS (
  SELECT host, greatest(3, CAST(floor(count(*) * 0.5) AS BIGINT) + 1) AS least FROM own GROUP BY host
), often AS (
  SELECT gram.host, gram.g FROM gram JOIN own ON own.u = gram.u JOIN least AS l ON l.host = gram.host
  GROUP BY gram.host, gram.g, l.least HAVING count(DISTINCT gram.u) >= l.least
), covered AS (
  SELECT u, i, coalesce(gone, false) AS gone FROM (
    SELECT t.u, t.i, t.i - max(h.i) OVER (PARTITION BY t.u ORDER BY t.i) < 8 AS gone
    FROM token AS t LEFT JOIN (SELECT gram.u, gram.i FROM gram JOIN often ON often.host = gram.host AND often.g = gram.g) AS h ON h.u = t.u AND h.i = t.i)
), piece AS (
  SELECT u, nth, b, n, sum(n) OVER (PARTITION BY u ORDER BY nth) AS past
  FROM (SELECT u, nth, bs[nth] AS b, len(string_split(bs[nth], ' ')) AS n FROM (SELECT u, bs, unnest(range(1, len(bs) + 1)) AS nth FROM unit))
), whole AS (
  SELECT p.u, p.nth, p.b, bool_and(c.gone) AS gone FROM piece AS p JOIN covered AS c ON c.u = p.u AND c.i > p.past - p.n AND c.i <= p.past GROUP BY p.u, p.nth, p.b
), main AS (
  SELECT u, coalesce(string_agg(b, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), string_agg(b, chr(10) ORDER BY nth)) AS text FROM whole GROUP BY u
)
SELECT b.page_id, b.url, coalesce(m.text, '') AS text, CAST(length(coalesce(m.text, '')) AS BIGINT) AS n_chars
FROM block AS b LEFT JOIN unit AS u ON u.host = b.host AND u.bs = b.bs LEFT JOIN main AS m ON m.u = u.u
"""
