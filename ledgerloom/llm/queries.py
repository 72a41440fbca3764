"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_vocabulary() -> str:
    """The published word-level BPE vocabulary installed beside Python."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    from .bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), default_vocabulary())
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template matches of every document."""
    from .licenses import license_scan

    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        names("base.label").alias("base_labels"),
        names("base.label", "found.label").alias("labels"),
        "score",
        F.size("found").cast("long").alias("n_template_places"),
    )


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document, learned from the labels of documents that aren't held out."""
    from .quality import fit_quality, quality_score

    docs = table(spark, sf_dir, "documents")
    scored = quality_score(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best matches of every vector whose id is divisible by 20."""
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    found = top_k(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL["op8_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover, and the items they come from."""
    from .decontaminate import contaminated, decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: Words in SQL: A-Z lower-cased, runs of letters, digits and everything outside ASCII.
SQL_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format("text")} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS win
    FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
),
dw AS (
    SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
h AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data exchanged for surrogates."""
    from .pii import surrogates

    done = surrogates(table(spark, sf_dir, "documents"), key="registered-query")
    count = lambda kind: F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long")
    kinds = ("email", "phone", "card", "ip", "secret", "person")
    return done.select("doc_id", "text", "n_entities", *[count(k).alias(f"n_{k}") for k in kinds])


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the component that links put it in."""
    from .ngramjoin import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS h
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
    SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 100-byte strings cover which also start earlier, and a digest of what remains."""
    from .suffixes import suffix_dedup

    done = suffix_dedup(table(spark, sf_dir, "documents"), 100)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; texts are cut into pieces of a thousand places, so that no string is taken from far inside a long one.
ORACLE_SQL["op1_suffix_dedup"] = """
WITH d AS MATERIALIZED (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS g, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS MATERIALIZED (
    SELECT g, o, substr(x, 2 * o + 1, 2198) AS x FROM (SELECT g, x, unnest(range(0, length(x) // 2, 1000)) AS o FROM d)
), s AS MATERIALIZED (
    SELECT g, o + i AS i, md5_number(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT g, o, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM b)
), f AS (SELECT h, min((g, i)) AS first FROM s GROUP BY h HAVING count(*) > 1),
r AS (SELECT g, i, i - lag(i) OVER (PARTITION BY g ORDER BY i) AS gap FROM s JOIN f USING (h) WHERE (g, i) <> first),
p AS (SELECT g, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM r),
c AS (SELECT g, span, min(i) AS a, max(i) + 100 AS e FROM p GROUP BY g, span),
k AS (SELECT g, a, e, lag(e, 1, 0) OVER (PARTITION BY g ORDER BY a) AS before FROM c),
m AS (
    SELECT g, count(*) AS n, sum(e - a) AS removed, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
    FROM k JOIN d USING (g) GROUP BY g
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN m USING (g)
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them stay when one line of each component of similar lines does, and what remains."""
    from .linededup import fuzzy_line_dedup

    done = fuzzy_line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_blank", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100."""
    from .graphsearch import build_index, nearest

    vectors = table(spark, sf_dir, "embeddings")
    found = nearest(build_index(vectors), vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents, its near words, and the more frequent one that it is a variant of."""
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def crc_nibbles() -> list[int]:
    """What four bits of a CRC-32 become."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sql_crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, four bits at a time, the lower ones of a byte first."""
    steps = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))"
    step = f"xor(c >> 4, list_extract({crc_nibbles()}::BIGINT[], CAST((xor(c, b) & 15) + 1 AS BIGINT)))"
    return f"xor(4294967295, list_reduce({steps}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)))"


ORACLE_SQL["op12_spelling_variants"] = f"""
WITH RECURSIVE t AS MATERIALIZED (
    SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS d, w, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents
    ) GROUP BY ALL
), h AS MATERIALIZED (SELECT w, n, {sql_crc32("d || ':' || w")} AS h FROM t),
v AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
s AS (SELECT DISTINCT e.word AS long, v.word AS short, e.n AS n_long, v.n AS n_short FROM e JOIN v ON v.word = e.a || e.z),
near AS MATERIALIZED (
    SELECT x.word, y.word AS other, y.n AS other_n FROM e x JOIN e y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
    UNION ALL SELECT long, short, n_short FROM s UNION ALL SELECT short, long, n_long FROM s
), b AS MATERIALIZED (
    SELECT v.word, v.n, count(other) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = m) AS best
    FROM v LEFT JOIN (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) USING (word) GROUP BY v.word, v.n
), f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN top >= 2 * n THEN best END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM b),
r AS (SELECT word, word AS last FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.last WHERE f.form IS NOT NULL)
SELECT f.word, form, last AS root, n, n_near, form_n FROM f JOIN r USING (word) JOIN (SELECT word AS last FROM f WHERE form IS NULL) USING (last)
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, harmed by a keyed draw: its faults, and the cheapest edits that repair its structure."""
    from .conversations import damaged, repair

    return repair(damaged(table(spark, sf_dir, "conversations")), present_col="present")
