"""The operators as registered queries over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewledger.llm import (
    collocations, conversation_trie, edit_embedding, external_shuffle, language_em, minhash_bbit, pack_reduction, pii_boost, quality_mcd, separator_scan, tokens, toxicity_lexicon,
    tree_bpe, url_rules,
)
from crewledger.session import use_checkpoints

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def working_folder(spark: SparkSession) -> str:
    """A folder of this call's own below the one that all executors share."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def op1_quality_mcd(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the verdict of the robust estimates for every document."""
    found = quality_mcd.judged(table(spark, folder, "documents"))
    return found.select("doc_id", f"{found.columns[-1]}.*")


def op2_language_em(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    found = language_em.with_language(table(spark, folder, "documents"))
    return found.select("doc_id", language_em.held_out().alias("held_out"), f"{found.columns[-1]}.*")


def op3_pack_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens."""
    return pack_reduction.pack(table(spark, folder, "documents"), tokens.public_path("word_bpe_49k.json"))


def op4_pii_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: base rules and boosted proposals."""
    return pii_boost.digests(table(spark, folder, "documents"))


def op5_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document after the two passes."""
    docs = table(spark, folder, "documents")
    found = external_shuffle.shuffled(docs)
    shard, grown, slot = found.columns[-3:]
    return found.select(
        "doc_id", external_shuffle.size_of("text").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"), F.lit("key").alias("law"),
        F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.col(grown).alias("grown_shard"))


def op6_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document in flat files written from all documents."""
    path = tokens.public_path("word_bpe_49k.json")
    end = separator_scan.separator_of(path)
    flat = f"{working_folder(spark)}/flat"
    separator_scan.write_flat(table(spark, folder, "documents"), flat, path, end)
    return separator_scan.count_documents(spark, flat, end)


def op7_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every text and the text they decode to, as digests."""
    path = tokens.public_path("byte_bpe_50k.json")
    return tree_bpe.digests(tree_bpe.encode(table(spark, folder, "documents"), path), path)


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL by hand-written and mined rules."""
    return url_rules.judged(table(spark, folder, "pages"))


def op9_minhash_bbit(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document among near-duplicates at 85 percent."""
    found = minhash_bbit.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_edit_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and the component of linked documents."""
    return edit_embedding.compared_and_linked(table(spark, folder, "documents"), f"{working_folder(spark)}/walked")


def op11_toxicity_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity_lexicon.learned(docs, table(spark, folder, "labels"))
    return toxicity_lexicon.scored(docs, lexicon).select(
        "doc_id", toxicity_lexicon.held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two to four words of every language."""
    return collocations.collocations(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))


def queries() -> dict[str, Query]:
    return {name: run for name, run in globals().items() if name.startswith("op") and name[2].isdigit()}


UPPER, LOWER = url_rules.UPPER, url_rules.LOWER

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[n : n + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS n FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS u, b.doc_id AS v
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n
        HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    reached AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other),
    found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM found LEFT JOIN sizes USING (doc_id)"""

_FITS = " ".join(
    f"WHEN (host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) "
    f"AND starts_with(path, '/{rule.partition('/')[2]}') THEN '{rule}'"
    for _, rule in sorted(url_rules.RULES, key=lambda r: (-len(r[1]), r[1])))
_VERDICTS = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for verdict, rule in url_rules.RULES)

URL_VERDICTS = rf"""
    WITH RECURSIVE rests AS (
        SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, url, rest, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query,
               translate(split_part(url, '://', 1), '{UPPER}', '{LOWER}') AS scheme FROM rests),
    low AS (SELECT *, translate(path, '{UPPER}', '{LOWER}') AS low, CASE {_FITS} END AS rule FROM parts),
    tokens AS (
        SELECT page_id, url, host, path, rule, CASE rule {_VERDICTS} END AS own, CASE WHEN rest = '' THEN [] ELSE list_distinct(list_concat(
            list_concat(list_transform(list_filter([scheme], lambda x: x <> ''), lambda x: 's:' || x),
                        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)),
            list_concat(
                list_concat(list_transform(list_filter(string_split(low, '/'), lambda x: regexp_full_match(x, '[^\x09-\x0D\x20.]+') AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'p:' || x),
                            list_transform(list_filter([regexp_extract(low, '\.([a-z]{{1,5}})$', 1)], lambda x: x <> ''), lambda x: 'e:' || x)),
                list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'q:' || x)))) END AS t
        FROM low),
    labelled AS (SELECT row_number() OVER () AS n, own, t FROM tokens WHERE own IS NOT NULL),
    items AS (
        SELECT n, own, i FROM (SELECT n, own, unnest(t) AS i FROM labelled)
        QUALIFY count(*) OVER (PARTITION BY i) >= ceil({url_rules.SUPPORT} * (SELECT count(*) FROM labelled))),
    sets AS (
        SELECT n AS owner, i AS name, 1 AS size, own, i AS last FROM items
        UNION ALL SELECT owner, name || ' ' || i, size + 1, sets.own, i FROM sets JOIN items ON n = owner AND i > last),
    counted AS (SELECT name, size, own, count(*) AS n, sum(count(*)) OVER (PARTITION BY name) AS all_n FROM sets GROUP BY name, size, own),
    rules AS (
        SELECT name, string_split(name, ' ') AS t, size, own AS verdict, n::DOUBLE / all_n::DOUBLE AS confidence, n AS support FROM counted
        WHERE n >= ceil({url_rules.SUPPORT} * (SELECT count(*) FROM labelled)) AND n::DOUBLE / all_n::DOUBLE >= {url_rules.CONFIDENCE}),
    others AS (SELECT DISTINCT url, t FROM tokens WHERE own IS NULL AND len(t) > 0),
    best AS (
        SELECT url, first(struct_pack(name := r.name, verdict := r.verdict)
                          ORDER BY confidence DESC, support DESC, size, r.name, r.verdict) AS b
        FROM others o JOIN rules r ON list_has_all(o.t, r.t) GROUP BY url)
    SELECT page_id, host, path, rule, coalesce(own, b.verdict, '{url_rules.DEFAULT}') AS verdict,
           CASE WHEN own IS NULL THEN b.name END AS mined_rule
    FROM tokens LEFT JOIN best USING (url)"""

# A checksum over the digits of an id, from a table that the polynomial gives.
CONVERSATION_TRIE = """
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce(list_concat([n], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY n) AS t
        FROM (SELECT unnest(range(256)) AS n)),
    turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY p) AS ts, CAST(c AS VARCHAR) AS digits FROM turns GROUP BY c),
    borrowing AS (
        SELECT c, ts, xor(list_reduce(list_concat([4294967295], list_transform(range(length(digits)), lambda i: CAST(ascii(digits[i + 1]) AS BIGINT))),
                                      lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295) % 6 AS h FROM own, crc),
    convs AS (
        SELECT b.c, list_concat(CASE WHEN o.c IS NULL THEN [] ELSE o.ts[1 : b.h] END, b.ts[b.h + 1 :]) AS k
        FROM borrowing b LEFT JOIN own o ON o.c = b.c - b.c % 100),
    members AS (SELECT c, k, unnest(generate_series(0, len(k))) AS d FROM convs),
    nodes AS (
        SELECT k[1 : d] AS k, d, min(c) AS c, count(*) AS n,
               sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(k) = d), '')) AS ends
        FROM members GROUP BY k[1 : d], d),
    kids AS (SELECT k[1 : d - 1] AS k, count(*) AS m FROM nodes WHERE d > 0 GROUP BY k[1 : d - 1]),
    valued AS (
        SELECT n.k, d, CASE WHEN m IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(n.k[d].x) END AS saved
        FROM nodes n LEFT JOIN kids USING (k)),
    sums AS (
        SELECT k[1 : e] AS k, CAST(sum(leaf) AS BIGINT) AS leaves, CAST(sum(saved) AS BIGINT) AS saved
        FROM (SELECT *, unnest(generate_series(0, d)) AS e FROM valued) GROUP BY k[1 : e])
    SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(m, 0) AS n_children, leaves AS n_leaves,
           saved AS saved_tokens, n.ends AS ends_sha256
    FROM nodes n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON n.d > 0 AND p.k = n.k[1 : n.d - 1]"""


COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    found AS (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(w) >= k)
        GROUP BY ALL),
    totals AS (SELECT lang, sum(f) AS n FROM found WHERE k = 1 GROUP BY lang),
    candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM found WHERE k > 1 AND f >= 30),
    cuts AS (
        SELECT c.lang, c.phrase, a, cut, h.f AS l, t.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (h.f + t.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
        JOIN found h ON h.lang = c.lang AND h.phrase = array_to_string(w[: cut], ' ')
        JOIN found t ON t.lang = c.lang AND t.phrase = array_to_string(w[cut + 1 :], ' ')),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    free AS (
        SELECT * FROM lowest s WHERE NOT EXISTS (
            SELECT 1 FROM (SELECT lang, k, a, array_to_string(w[i : i + m - 1], ' ') AS phrase
                           FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM candidates, (VALUES (2), (3)) AS s(m) WHERE m < k)) g
            WHERE g.lang = s.lang AND g.phrase = s.phrase AND 100 * g.a >= 80 * s.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM free JOIN totals USING (lang) QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express."""
    return {"op8_url_rules": URL_VERDICTS, "op9_minhash_bbit": NEAR_DUPLICATES, "op12_collocations": COLLOCATIONS,
            "op13_conversation_trie": CONVERSATION_TRIE}
