"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_report
from .collocations import collocations
from .common import read
from .decontaminate import find_leaks
from .langid import identify
from .minhash import near_duplicates
from .pieces import token_report
from .repeats import remove_repeats
from .secrets import find_secrets
from .sharding import shard_documents
from .spelling import word_variants
from .suffixes import remove_repeated_bytes
from .vectors import near_vectors
from .warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    r AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM r)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
    FROM m
    """,
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(read(spark, sf_dir, "documents"))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


@query(
    "op6_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
      coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
    """,
)
def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))


@query("op1_minhash")
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query(
    "op2_repeats",
    r"""
    WITH w AS (
      SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS t FROM documents WHERE text IS NOT NULL)),
    h AS (
      SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 50 THEN md5(string_agg(word, ' ') OVER f) END AS k
      FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    o AS (SELECT k, min(doc_id) AS low FROM h WHERE k IS NOT NULL GROUP BY k),
    m AS (SELECT doc_id, i, word, coalesce(low < doc_id, false) AS begins FROM h LEFT JOIN o USING (k)),
    c AS (
      SELECT doc_id, i, word, bool_or(begins) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM m),
    r AS (
      SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
      FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN r USING (doc_id)
    """,
)
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_suffixes",
    """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    d AS (SELECT doc_id, c, substring(h, 800 * c + 1, 1600) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 800 + 1)) AS c FROM b)),
    p AS (
      SELECT doc_id, 400 * c + j AS i, substring(h, 2 * j - 1, 2) AS x, CASE WHEN len(h) >= 2 * j + 798 THEN md5(substring(h, 2 * j - 1, 800)) END AS k
      FROM (SELECT *, unnest(range(1, 401)) AS j FROM d) WHERE len(h) >= 2 * j),
    t AS (SELECT k FROM p WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
    m AS (SELECT doc_id, i, x, t.k IS NOT NULL AS begins FROM p LEFT JOIN t USING (k)),
    c AS (
      SELECT doc_id, i, x, bool_or(begins) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone
      FROM m),
    e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
    r AS (
      SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
        string_agg(x, '' ORDER BY i) FILTER (NOT gone) AS kept
      FROM e GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
      coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM documents d LEFT JOIN r USING (doc_id)
    """,
)
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated_bytes(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(read(spark, sf_dir, "documents"))


@query(
    "op13_spelling",
    """
    WITH RECURSIVE t AS (
      SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
        ORDER BY i) AS crc
      FROM range(0, 256) r(i)),
    r AS (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]+')) AS run FROM documents),
    u AS (
      SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
      FROM r WHERE length(run) >= 7 GROUP BY ALL),
    b AS (
      SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM u),
    h AS (
      SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)]))) AS h FROM b, t),
    w AS (
      SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
    v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    d AS (
      SELECT DISTINCT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    p AS (
      SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
    f AS (
      SELECT v.word, v.n, count(p.other) AS n_near, arg_min(p.other, (-p.n, p.other)) AS best, max(p.n) AS most
      FROM v LEFT JOIN p USING (word) GROUP BY ALL),
    g AS (SELECT word, n, n_near, CASE WHEN most >= 10 * n THEN best END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM f),
    s AS (
      SELECT word, word AS here, 0 AS steps FROM g
      UNION ALL SELECT s.word, g.form, s.steps + 1 FROM s JOIN g ON s.here = g.word WHERE g.form IS NOT NULL)
    SELECT g.word, g.form, e.root, g.n, g.n_near, g.form_n
    FROM g JOIN (SELECT word, arg_max(here, steps) AS root FROM s GROUP BY word) e USING (word)
    """.replace("\\u00C0-\\u00FF", "À-ÿ"),
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_variants(read(spark, sf_dir, "documents"))


@query(
    "op11_collocations",
    r"""
    WITH t AS (
      SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents WHERE text IS NOT NULL),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang HAVING sum(len(ws)) > 0),
    g AS (
      SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, range(1, 5) r(k)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
    x AS (
      SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    s AS (
      SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * x.a // (l.f + r.f))::BIGINT AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (
      SELECT lang, a, array_to_string(ws[j:j + m - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
    o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL),
    q AS (
      SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
      WHERE o.around IS NULL OR 100::HUGEINT * o.around < 80::HUGEINT * b.a)
    SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n USING (lang) WHERE q.rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
