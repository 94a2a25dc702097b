"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.llm.common import scratch, table
from marlstone.llm.substring import UNIT


def op10_quality_rules(spark, sf_dir):
    from marlstone.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    from marlstone.llm.tokens import read_token_files, token_index, write_token_files

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_index(read_token_files(spark, path))


def op2_mix_sources(spark, sf_dir):
    from marlstone.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark, sf_dir):
    from marlstone.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_extraction(spark, sf_dir):
    from marlstone.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_chat_repair(spark, sf_dir):
    from marlstone.llm.chat import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))


def op5_substring_dedup(spark, sf_dir):
    from marlstone.llm.substring import dedup_units

    return dedup_units(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    from marlstone.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    from marlstone.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark, sf_dir):
    from marlstone.llm.suffix import dedup_substrings

    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", F.expr("make_valid_utf8(cast(kept as string))").alias("text"), "n_passages", "passage_bytes", "passages")


def op11_token_counts(spark, sf_dir):
    import public_tokenizers

    from marlstone.llm.prefixes import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)


def op12_collocations(spark, sf_dir):
    from marlstone.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark, sf_dir):
    from marlstone.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_embedding_whitening": op13_embedding_whitening,
    "op1_suffix_dedup": op1_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op3_chat_repair": op3_chat_repair,
    "op4_decontaminate": op4_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op7_token_files": op7_token_files,
    "op8_html_extraction": op8_html_extraction,
    "op10_quality_rules": op10_quality_rules,
}

_WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {
    "op12_collocations": rf"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
        n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
        g AS MATERIALIZED (
            SELECT lang, k, w[i : i + k - 1] AS v, count(*)::HUGEINT AS f
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k)
            GROUP BY ALL HAVING count(*) >= 100),
        c AS (
            SELECT g.lang, g.v, g.f AS a, x.f AS l, y.f AS r, n.n, 1000::HUGEINT * g.f * n.n // (x.f * y.f) AS score,
                   row_number() OVER (PARTITION BY g.lang, g.v ORDER BY 1000::HUGEINT * g.f * n.n // (x.f * y.f), x.k) AS place
            FROM g JOIN n USING (lang) JOIN g x ON x.lang = g.lang AND x.k < g.k AND x.v = g.v[1 : x.k]
            JOIN g y ON y.lang = g.lang AND y.k = g.k - x.k AND y.v = g.v[x.k + 1 :]
            WHERE g.k > 1),
        inner_parts AS (
            SELECT lang, k, v[i : i + m - 1] AS v, f
            FROM (SELECT lang, k, v, f, m, unnest(range(1, k - m + 2)) AS i FROM g, range(2, 5) t(m) WHERE m < k)),
        longer AS (SELECT lang, v, max(f) AS most FROM inner_parts GROUP BY ALL),
        b AS (
            SELECT c.lang, array_to_string(c.v, ' ') AS phrase, a, l, r, n, score,
                   row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.v, ' ')) AS rank
            FROM c LEFT JOIN longer o ON o.lang = c.lang AND o.v = c.v
            WHERE place = 1 AND (most IS NULL OR 100 * most < 100 * a))
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM b WHERE rank <= 2000
    """,
    "op9_jaccard_join": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
        g AS MATERIALIZED (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS gram
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        e AS MATERIALIZED (
            SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
        s AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, s.y FROM r JOIN s ON r.z = s.x)
        SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(z) AS component_id
        FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op5_substring_dedup": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{UNIT.replace("*+", "*")}') AS w FROM documents),
        u AS (
            SELECT doc_id, i, unit, trim(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
                   (sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS end_at
            FROM (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS unit FROM d)),
        r AS (
            SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS again FROM u),
        g AS (
            SELECT *, i - row_number() OVER (PARTITION BY doc_id, again ORDER BY i) AS run FROM r),
        x AS (
            SELECT *, again AND sum(length(unit)) OVER (PARTITION BY doc_id, again, run) >= 150 AS long FROM g),
        s AS (
            SELECT doc_id, string_agg(span, ',' ORDER BY b) AS spans, count(*) FILTER (long) AS n_passages, sum(chars) FILTER (long) AS chars, string_agg(span, ',' ORDER BY b) FILTER (long) AS long_spans
            FROM (SELECT doc_id, long, min(end_at - length(unit)) AS b, sum(length(unit)) AS chars, min(end_at - length(unit)) || '-' || max(end_at) AS span FROM x WHERE again GROUP BY doc_id, run, long)
            GROUP BY doc_id),
        k AS (
            SELECT doc_id, count(*) AS n_units, count(*) FILTER (again) AS n_removed, string_agg(unit, '' ORDER BY i) FILTER (NOT again) AS kept, string_agg(unit, '' ORDER BY i) FILTER (NOT long) AS kept_long
            FROM x GROUP BY doc_id)
        SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS removed_spans, coalesce(kept, '') AS text,
               coalesce(n_passages, 0) AS n_passages, coalesce(chars, 0)::BIGINT AS passage_chars, coalesce(long_spans, '') AS passage_spans, coalesce(kept_long, '') AS text_without_passages
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
    "op4_decontaminate": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS w FROM documents),
        b AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM win),
        g AS (
            SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
        m AS (SELECT doc_id, i, g.n, item FROM g JOIN win ON g.n = win.n AND g.gram = win.gram),
        h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
        t AS (
            SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op2_mix_sources": rf"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
                   substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15) AS h
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS total, sum(sum(size)) OVER ()::BIGINT AS everything,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
            FROM d GROUP BY source),
        r AS (
            SELECT *, row_number() OVER o AS rank,
                   coalesce(2 * sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
                   (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights
            FROM s WINDOW o AS (ORDER BY total / w, source NULLS LAST)),
        f AS (
            SELECT rank AS first_rank, capped AS first_capped, weights AS first_weights FROM r
            WHERE NOT w::HUGEINT * (150::HUGEINT * everything - 100::HUGEINT * capped) > 200::HUGEINT * total * weights
            ORDER BY rank LIMIT 1),
        t AS (
            SELECT source, total, CASE WHEN rank >= first_rank
                   THEN w * (1.5::DOUBLE * everything - first_capped) / first_weights ELSE (2 * total)::DOUBLE END AS target
            FROM r LEFT JOIN f ON true),
        p AS (
            SELECT source, total, target, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole FROM t),
        c AS (
            SELECT source, h, sum(size) AS words, max(size) AS each FROM d GROUP BY source, h),
        u AS (
            SELECT c.source, h, words, each, sum(words) OVER (PARTITION BY c.source ORDER BY h) AS upto, target - whole * total AS part
            FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
        e AS (
            SELECT source, h, upto <= part AS before_edge, h = min(CASE WHEN upto > part THEN h END) OVER (PARTITION BY source) AS at_edge,
                   CASE WHEN each > 0 THEN floor((part - upto + words) / each) + ((part - upto + words) - each * floor((part - upto + words) / each) > each / 2)::INT ELSE 0 END AS fit
            FROM u),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS copy FROM d)
        SELECT n.doc_id, n.size, p.total AS source_size, p.target, (n.size * (p.whole + (before_edge OR at_edge AND copy <= fit)::INT))::BIGINT AS taken
        FROM n JOIN p ON n.source IS NOT DISTINCT FROM p.source
        JOIN e ON n.source IS NOT DISTINCT FROM e.source AND n.h = e.h
    """,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
