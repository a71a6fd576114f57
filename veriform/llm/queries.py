"""Registered queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_blocks, lattice_lm, line_rules, quality_model, simhash, source_mix, substring_dedup, token_count, toxicity, url_cascade, whitening

TOKENIZER = "piece_bpe_32k.model"
MAX_TOKENS = 4096
RULES = [
    url_cascade.Rule("net/", "block"), url_cascade.Rule("example.net/en/", "allow"),
    url_cascade.Rule("example.com/de/", "block"), url_cascade.Rule("org/fr/", "allow"),
]
# Names of sites whose hosts are listed. Fixed values.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start_word", "end_word", "copy_of")


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = line_rules.clean_lines(table(spark, sf_dir, "documents"), with_text=False)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept"), "lines_lost", "words_lost")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = source_mix.mix(table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scores = token_count.load_pieces(str(public_tokenizers.path(TOKENIZER)))
    c = token_count.token_counts(table(spark, sf_dir, "documents"), scores)
    return c.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def _listed(host):
    return F.arrays_overlap(F.split(host, r"\."), F.array(*[F.lit(n) for n in LISTED_NAMES]))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_cascade.judge_urls(table(spark, sf_dir, "pages"), RULES, _listed)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = html_blocks.extract_main_text(table(spark, sf_dir, "pages"))
    return t.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, most=2000)
    return c.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scores = token_count.load_pieces(str(public_tokenizers.path(TOKENIZER)))
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), scores).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_line_rules, op3_source_mix, op4_token_count, op5_url_filter, op6_quality, op7_decontaminate, op8_html_text, op9_toxicity, op10_simhash,
    op11_embedding_whitening, op12_collocations, op13_lattice_lm)}

ORACLES = {
    "op12_collocations": rf"""
        WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
            FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}') AS t FROM documents)),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) s(k) WHERE len(w) >= k)
            GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT lang, k, phrase, f AS a FROM g WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM g q
            WHERE q.lang = g.lang AND q.k > g.k AND contains(' ' || q.phrase || ' ', ' ' || g.phrase || ' ') AND 100 * q.f >= 100 * g.f)),
        cut AS (SELECT c.lang, c.phrase, c.a, c.j, n.n, x.f AS l, y.f AS r, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS j FROM c) c JOIN n ON n.lang = c.lang
            JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.s[1 : c.j], ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.s[c.j + 1 : c.k], ' ')),
        best AS (SELECT lang, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cut) WHERE nth = 1)
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best) WHERE rank <= 2000
    """,
    "op5_url_filter": rf"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
        p AS (SELECT page_id, translate(raw, '{url_cascade.UPPER}', '{url_cascade.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        r AS (SELECT *, CASE
            WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN list_has_any(string_split(host, '.'), {list(LISTED_NAMES)}) THEN 'block' ELSE 'allow' END AS verdict FROM r
    """,
    "op7_decontaminate": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS words, least(len(w), 10) AS n FROM s),
        sizes AS (SELECT DISTINCT n FROM win),
        e AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
        g AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM e),
        hit AS (SELECT g.r, g.i, g.n, win.item FROM g JOIN win USING (words, n)),
        spots AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS pos FROM hit),
        n_hit AS (SELECT r, count(*) AS n_hit FROM spots GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r)
    """,
}
