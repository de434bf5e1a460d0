"""The queries of this subpackage, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.decontamination import contaminated
from kerbside.llm.exact_dedup import content_groups
from kerbside.llm.fill_in_middle import fim_report
from kerbside.llm.lexical_search import ranked_search
from kerbside.llm.mixing import mix_sources
from kerbside.llm.ngram_jaccard import ngram_components
from kerbside.llm.pii import personal_report
from kerbside.llm.quality_classifier import quality_scores
from kerbside.llm.quality_rules import quality_rules
from kerbside.llm.secret_scan import secret_report
from kerbside.llm.token_output import token_index
from kerbside.llm.toxicity import toxic_passages
from kerbside.llm.warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxic_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shown = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string"), F.format_string("%.3f", p["score"]))), ",")
    return d.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"), shown.alias("passages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.i >= 80 * (x.n + y.n - p.i)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS BIGINT) + 1] AS w, source_size * 3 AS most FROM s),
r AS (SELECT *, most / w AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER o AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS level
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source)),
f AS (SELECT min(k) AS free, arg_min(level, k) AS level FROM l WHERE level <= ratio),
t AS (
  SELECT l.source, l.source_size, CASE WHEN f.free IS NULL OR l.k < f.free THEN CAST(l.most AS DOUBLE) ELSE l.w * f.level END AS target FROM l, f),
p AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS INTEGER) AS whole FROM t),
c AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.key) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (
  SELECT *, whole + CASE WHEN upto <= part OR (upto - own < part AND upto - part < part - upto + own) THEN 1 ELSE 0 END AS repeats FROM c)
SELECT doc_id, size, source_size, target, repeats, CAST(size * repeats AS BIGINT) AS taken FROM e
"""


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda g:
    array_to_string(list_transform(range(0, 4), lambda k:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || hex[g * 5 + 1:g * 5 + 5] AS BIGINT) >> CAST(15 - 5 * k AS BIGINT)) & 31 AS BIGINT) + 1]), '')), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM m
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, term, n, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term, n),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM f GROUP BY term), g),
q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""


OP12_SQL = r"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
h AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || k[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || k[9:16] AS BIGINT) % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || k[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
      WHEN CAST('0x' || k[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(x, y)], ''), '') AS a,
    coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') AS b, coalesce(array_to_string(u[greatest(x, y) + 1:n], ''), '') AS c FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def queries() -> dict:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_mixing": op2_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_toxicity": op4_toxicity,
        "op5_secret_scan": op5_secret_scan,
        "op6_warc": op6_warc,
        "op7_token_output": op7_token_output,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_quality_rules": op10_quality_rules,
        "op11_lexical_search": op11_lexical_search,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op2_mixing": OP2_SQL, "op6_warc": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
