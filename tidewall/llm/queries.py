"""The operators as registered queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewall.llm import ann, bpe, collocations, conversations, digest, mixing, quality, simhash, suffix, tokencount, tokenfile, toxicity, warc
from tidewall.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources")
def mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op2_token_files")
def token_files(spark, sf_dir):
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json")))


@query("op3_simhash")
def simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


@query("op5_token_counts")
def token_counts(spark, sf_dir):
    """Token counts (with the end id) of the documents' flat files: doc_id, file's document number, start, n_tokens."""
    names = tokencount.write_flat(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern(), 50256)
    counts = tokencount.count_tokens(names.select("path").distinct(), 50256)
    return counts.join(names, ["path", "ordinal"], "full").select("doc_id", "ordinal", "start", "n_tokens", "complete")


@query(
    "op6_warc",
    """WITH sized AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
originals AS (
    SELECT sha1(body) AS digest, max(page_id) AS original FROM sized WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM sized LEFT JOIN originals ON digest = sha1(body)""",
)
def warc_round_trip(spark, sf_dir):
    archives = warc.write_archives(warc.with_originals(table(spark, sf_dir, "pages")))
    return warc.read_archives(archives).drop("payload", "url")


@query("op7_nearest")
def nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op8_digest")
def quartile_digest(spark, sf_dir):
    return digest.fingerprints(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def toxicity_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs.select("doc_id", "text"))
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op10_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    return suffix.digests(suffix.remove_repeats(table(spark, sf_dir, "documents")))


@query("op11_quality")
def quality_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.fit(docs, table(spark, sf_dir, "labels")).score(docs.select("doc_id", "text", "n_chars"))
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op12_repair_conversations")
def repair_conversations(spark, sf_dir):
    damaged = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(damaged))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op13_collocations",
    f"""WITH numbered AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[.,;:!?\\x0A-\\x0D]') AS parts
    FROM documents),
pieces AS (SELECT d, lang, unnest(parts) AS piece, generate_subscripts(parts, 1) AS p FROM numbered),
worded AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
each_word AS (SELECT d, lang, p, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM worded),
threes AS (
    SELECT lang, x, lead(x, 1) OVER at_place AS y, lead(x, 2) OVER at_place AS z FROM each_word
    WINDOW at_place AS (PARTITION BY d, p ORDER BY i)),
f1 AS (SELECT lang, x, CAST(count(*) AS HUGEINT) AS f FROM threes GROUP BY ALL),
f2 AS (SELECT lang, x, y, CAST(count(*) AS HUGEINT) AS f FROM threes WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, CAST(count(*) AS HUGEINT) AS f FROM threes WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
inside AS (
    SELECT lang, x, y, max(f) AS longer
    FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y),
of_two AS (
    SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, u.f AS l, v.f AS r, (1000000 * c.f * c.f) // (u.f * v.f) AS score
    FROM f2 c JOIN f1 u ON u.lang = c.lang AND u.x = c.x JOIN f1 v ON v.lang = c.lang AND v.x = c.y
    LEFT JOIN inside i ON i.lang = c.lang AND i.x = c.x AND i.y = c.y
    WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.f),
cuts AS (
    SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z AS phrase, c.f AS a, u.f AS l1, t.f AS r1, h.f AS l2, v.f AS r2,
           (1000000 * c.f * c.f) // (u.f * t.f) AS s1, (1000000 * c.f * c.f) // (h.f * v.f) AS s2
    FROM f3 c JOIN f1 u ON u.lang = c.lang AND u.x = c.x JOIN f1 v ON v.lang = c.lang AND v.x = c.z
    JOIN f2 h ON h.lang = c.lang AND h.x = c.x AND h.y = c.y JOIN f2 t ON t.lang = c.lang AND t.x = c.y AND t.y = c.z),
kept AS (
    SELECT * FROM of_two UNION ALL
    SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
)
def phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
