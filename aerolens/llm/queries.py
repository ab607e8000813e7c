"""The registered queries of this subpackage, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolens.llm import chat, collocations, decontamination, fuzzy_lines, licenses, mixing, packing, prefix_trie, quality, sharding, simhash, token_files, toxicity
from aerolens.llm.texts import importable, n_words
from aerolens.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = call
        if sql:
            CHECKS[name] = sql
        return call
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.shard(docs, 40, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


LICENSE_SQL = r"""
    WITH raw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
    base AS (SELECT unnest([BASE_LABELS]) AS label, unnest([BASE_PHRASES]) AS phrase),
    template AS (SELECT unnest(range(len([LABELS]))) AS t, unnest([LABELS]) AS label, unnest([TEXTS]) AS text),
    phrase_of AS (SELECT unnest([KEY_OF]) AS t, unnest([KEYS]) AS key, unnest([KEY_AT]) AS key_at),
    tw AS (SELECT t, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS p FROM template),
    vocabulary AS (SELECT DISTINCT w FROM tw UNION SELECT unnest(string_split(phrase, ' ')) FROM base),
    wd AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM raw),
    spots AS (SELECT doc_id, w, i FROM wd SEMI JOIN vocabulary USING (w)),
    idf AS (SELECT v.w, ln(((SELECT count(*) FROM raw) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM vocabulary v LEFT JOIN spots ON v.w = spots.w GROUP BY v.w),
    found AS (SELECT doc_id, i, label FROM spots JOIN base ON spots.w = split_part(phrase, ' ', 1) JOIN raw USING (doc_id)
      WHERE words[i + 1:i + len(string_split(phrase, ' '))] = string_split(phrase, ' ')),
    based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY doc_id),
    keyed AS (SELECT DISTINCT doc_id, t FROM spots JOIN phrase_of ON w = split_part(key, ' ', 1) JOIN raw USING (doc_id)
      WHERE words[i + 1:i + len(string_split(key, ' '))] = string_split(key, ' ')),
    rare AS (SELECT DISTINCT doc_id, t, w, idf FROM (SELECT DISTINCT doc_id, w FROM spots) JOIN idf USING (w) JOIN (SELECT DISTINCT t, w FROM tw) USING (w) JOIN keyed USING (doc_id, t)
      QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY idf DESC, w) <= ANCHORS),
    votes AS (SELECT doc_id, t, i - p AS place FROM rare JOIN spots USING (doc_id, w) JOIN tw USING (t, w) WHERE i >= p GROUP BY ALL HAVING count(DISTINCT w) >= AGREE),
    kept AS (SELECT doc_id, t, any_value(label) AS label, place, any_value(words) AS words FROM votes JOIN template USING (t) JOIN phrase_of USING (t) JOIN raw USING (doc_id)
      GROUP BY doc_id, t, place HAVING bool_and(words[place + key_at + 1:place + key_at + len(string_split(key, ' '))] = string_split(key, ' '))),
    weight AS (SELECT t, sum(idf) AS total FROM tw JOIN idf USING (w) GROUP BY t),
    shares AS (SELECT doc_id, label, place, t, least(1, sum(CASE WHEN words[place + p + 1] = w THEN idf ELSE 0 END) / any_value(total)) AS share
      FROM kept JOIN tw USING (t) JOIN idf USING (w) JOIN weight USING (t) GROUP BY ALL),
    accepted AS (SELECT s.doc_id, s.label, share FROM shares s LEFT JOIN (SELECT DISTINCT doc_id, label FROM found) f ON s.doc_id = f.doc_id AND s.label = f.label
      WHERE share >= LEAST_SHARE OR f.label IS NOT NULL),
    named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(max(share), LEAST_SHARE) AS score
      FROM (SELECT * FROM accepted UNION ALL SELECT doc_id, label, NULL FROM found) GROUP BY doc_id)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
      coalesce(labels, '') AS labels, round(coalesce(score, 0)::DOUBLE, 6) AS score FROM raw LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _license_sql() -> str:
    def texts(values) -> str:
        return "[" + ", ".join(f"'{v if isinstance(v, str) else v.decode()}'" for v in values) + "]"

    templates = licenses.TEMPLATES
    keys = [(t, text, key) for t, (_, text, phrases) in enumerate(templates) for key in phrases]
    named = {"[BASE_LABELS]": texts(licenses.BASE.values()), "[BASE_PHRASES]": texts(licenses.BASE), "[LABELS]": texts(t[0] for t in templates),
             "[TEXTS]": texts(t[1] for t in templates), "[KEY_OF]": str([t for t, _, _ in keys]), "[KEYS]": texts(key for _, _, key in keys),
             "[KEY_AT]": str([licenses.word_at(text, key) for _, text, key in keys]),
             "ANCHORS": str(licenses.ANCHORS), "AGREE": str(licenses.AGREE), "LEAST_SHARE": repr(licenses.LEAST)}
    sql = LICENSE_SQL
    for name, value in named.items():
        sql = sql.replace(name, value)
    return sql


@query("op2_licenses", _license_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_chat", """
    WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position
               FROM conversations),
    c AS (SELECT conv_id, count(*) AS n, list([coalesce(role, '~'), coalesce(text, '~')] ORDER BY position) AS turns FROM t GROUP BY conv_id),
    covered AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.turns[1] = b.turns[1] AND a.n <= b.n AND b.turns[1:a.n] = a.turns
                WHERE a.n < b.n OR b.conv_id < a.conv_id)
    SELECT conv_id, position, role, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
    FROM t WHERE conv_id NOT IN (SELECT conv_id FROM covered)""")
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op7_fuzzy_lines")
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.kept_lines(table(spark, sf_dir, "documents"))


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.digests(token_files.read_tokens(spark, path))


def _covered_sql(n: int, first: bool) -> str:
    """Words of n-word windows that some other window (an earlier one, without ``first``) of the text equals."""
    gram = "w" + "".join(f" || ' ' || lead(w, {i}) OVER p" for i in range(1, n))
    seen = "count(*) OVER (PARTITION BY doc_id, g)" if first else "row_number() OVER (PARTITION BY doc_id, g ORDER BY i)"
    return f"""g{n} AS (SELECT doc_id, i, c, {gram} AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    r{n} AS (SELECT doc_id, i, c, CASE WHEN g IS NOT NULL THEN {seen} ELSE 0 END > 1 AS again FROM g{n}),
    c{n} AS (SELECT doc_id, c, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM r{n}),
    s{n} AS (SELECT doc_id, count(*) FILTER (inside) AS words, coalesce(sum(c) FILTER (inside), 0)::BIGINT AS chars FROM c{n} GROUP BY doc_id)"""


QUALITY_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    x AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
    w AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i, length(unnest(words)) AS c FROM x),
    n AS (SELECT doc_id, count(*) AS n_words, sum(c)::BIGINT AS word_chars FROM w GROUP BY doc_id),
    y AS (SELECT doc_id, string_split(t, chr(10)) AS lines FROM d),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM y),
    k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') AS again FROM l),
    m AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines,
          coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) FILTER (again), 0)::BIGINT AS line_chars FROM k GROUP BY doc_id),
    """ + ", ".join([_covered_sql(3, True), *(_covered_sql(n, False) for n in quality.MOST_IN_GRAMS)]) + """,
    b AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      n_dup_lines, coalesce(s3.words, 0) AS n_repeat_words, line_chars, """ + ", ".join(f"coalesce(s{n}.chars, 0) AS in{n}" for n in quality.MOST_IN_GRAMS) + """
      FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id) LEFT JOIN s3 USING (doc_id) """ + " ".join(
        f"LEFT JOIN s{n} USING (doc_id)" for n in quality.MOST_IN_GRAMS) + f""")
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_chars / word_chars <= {quality.MOST_IN_LINES!r}::DOUBLE AND """ + " AND ".join(
        f"in{n} / word_chars <= {most!r}::DOUBLE" for n, most in quality.MOST_IN_GRAMS.items()) + " AS kept FROM b"


@query("op9_quality", QUALITY_SQL)
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_mixing", """
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                      substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM s),
    l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
                    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
          FROM w WINDOW before AS (ORDER BY source_size::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, rank, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM l),
    p AS (SELECT d.*, t.source_size, t.rank, t.target, sum(size) OVER (PARTITION BY t.rank ORDER BY k, doc_id) AS upto
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT doc_id, size, rank, upto + copy * source_size AS done, (upto + copy * source_size)::DOUBLE / target AS finish
          FROM p, (VALUES (0), (1)) c(copy) WHERE size > 0),
    q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, done) AS taken FROM e),
    n AS (SELECT doc_id, sum(size) AS taken FROM q WHERE taken <= (SELECT 1.5 * sum(source_size) FROM s) GROUP BY doc_id)
    SELECT doc_id, size, source_size, target, coalesce(n.taken, 0)::BIGINT AS taken FROM p LEFT JOIN n USING (doc_id)""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


TRIE_SQL = """
    WITH t AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
                      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words, turn
               FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(words ORDER BY turn NULLS FIRST, key) AS words FROM t GROUP BY conv_id),
    h AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x // 2, 3988292384 * (x % 2)))), 4294967295) % 4)::BIGINT AS h FROM c),
    r AS (SELECT h.conv_id, coalesce(b.keys, [])[1:h] || h.keys[h + 1:] AS keys, coalesce(b.words, [])[1:h] || h.words[h + 1:] AS words
          FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
    p AS (SELECT conv_id, d, array_to_string(keys[1:d], '') AS path, coalesce(words[d], 0) AS words, d = len(keys) AS ending
          FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM r)),
    n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ending), '')) AS ends_sha256 FROM p GROUP BY path),
    k AS (SELECT n.*, q.conv_id AS parent_conv_id, left(n.path, 32 * (n.depth - 1)) AS parent FROM n LEFT JOIN n q ON n.depth > 0 AND q.path = left(n.path, 32 * (n.depth - 1))),
    s AS (SELECT parent AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY parent),
    u AS (SELECT left(path, 32 * e) AS path, sum((n_convs - 1) * words)::BIGINT AS saved_tokens, count(*) FILTER (childless) AS n_leaves
          FROM (SELECT n.*, s.path IS NULL AS childless, unnest(range(depth + 1)) AS e FROM n LEFT JOIN s USING (path)) GROUP BY 1)
    SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
    FROM k LEFT JOIN s USING (path) JOIN u USING (path)"""


@query("op11_prefix_trie", TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(*prefix_trie.rebuilt(prefix_trie.ordered(table(spark, sf_dir, "conversations"))))


COLLOCATION_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
    t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
    p AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w), (VALUES (1), (2), (3), (4)) s(k)
          WHERE i + k - 1 <= len(words)),
    f AS (SELECT lang, k, phrase, split(phrase, ' ') AS words, count(*) AS f FROM p GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, k, phrase, words, f AS a FROM f WHERE k > 1),
    u AS (SELECT *, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
    s AS (SELECT u.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = head
          JOIN f y ON y.lang = u.lang AND y.phrase = tail QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1),
    i AS (SELECT lang, array_to_string(words[b:b + z - 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2), (3)) v(b), (VALUES (2), (3)) q(z)
          WHERE z < k AND b + z - 1 <= k GROUP BY ALL),
    o AS (SELECT s.* FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000"""


@query("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_packing")
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = packing.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return packing.pieces(packing.fragments(encoded, packing.SIZE, keep_ids=False))
