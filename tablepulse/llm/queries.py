"""One query per operator over the whole given tables, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm import (
    bitpack, bpe, chat, divergence, kdsearch, licences, mixing, negatives, simhash, spelling, substrings, toxicity, winnowing,
)
from tablepulse.llm.storage import landed, new_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(spark, folder.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


WORD_SQL = r"[^\x20\x09-\x0D]+"


@query("op10_repeated_passages", f"""
    WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD_SQL}'), []) AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS s
            FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w)),
    shared AS (SELECT s, MIN(doc_id) AS least FROM win GROUP BY s HAVING MIN(doc_id) < MAX(doc_id)),
    gone AS (SELECT DISTINCT doc_id, i + j AS k
             FROM win JOIN shared USING (s), (SELECT unnest(generate_series(0, 12)) AS j) WHERE doc_id > least),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text
             FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
    LEFT JOIN kept USING (doc_id)""")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    left = substrings.remove_repeats(docs)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))
    kept = F.sha2(F.array_join(words, " "), 256)
    return left.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query("op2_packed_ids")
def packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    to = new_folder(spark, "packed_ids")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    manifest = bitpack.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), to, bits=(49_408 - 1).bit_length())
    found = bitpack.read_ids(spark, to, manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def coded_columns() -> list[Column]:
    """Digests of encoded documents."""
    return [
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


@query("op3_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.recode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", *coded_columns())


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


MIX_WEIGHTS = [
    {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    {"src0": 2.0},
]
MIX = {"share": 0.9, "max_epochs": 2, "seed": 11}


def domain(source) -> Column:
    """Domain of a source, by the number in its name."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1), F.lit("999999999999999999"))
    return F.concat(F.lit("d"), F.coalesce(number, F.lit(0)).cast("bigint") % 4)


def mixed(docs: DataFrame) -> DataFrame:
    """Documents mixed by domain, language and source; tokens are words."""
    levels = {"domain": domain(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)")))
    return mixing.mix(docs, levels, MIX_WEIGHTS, words, **MIX)


def _share_out_sql(name: str, above: str, parent: list[str], label: str, weights: dict) -> str:
    """The budgets of one level in SQL: relations of this name, from the budgets above."""
    over = f"PARTITION BY {', '.join(parent)}" if parent else ""
    weight = " ".join(f"WHEN {label} = '{k}' THEN {v}e0" for k, v in weights.items())
    keys = ", ".join([*parent, label])
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in parent)
    join = f"x JOIN (SELECT {', '.join(f'{k} AS {k}' for k in parent)}, parent_budget FROM {above}) y ON {same}" if parent else f"x CROSS JOIN {above}"
    own = ", ".join(f"x.{k}" for k in (*parent, label))
    return f"""
    {name}1 AS (SELECT {own}, cap, w, parent_budget, cap / w AS r FROM (
        SELECT {keys}, SUM(cap) AS cap, CASE {weight} ELSE 1.0e0 END AS w FROM leaves GROUP BY {keys}) {join}),
    {name}2 AS (SELECT *, (parent_budget - coalesce(SUM(cap) OVER b, 0)) / (SUM(w) OVER ({over}) - coalesce(SUM(w) OVER b, 0)) AS lv
        FROM {name}1 WINDOW b AS ({over} ORDER BY r, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name}3 AS (SELECT *, first_value(lv) OVER ({over} ORDER BY (cap <= lv * w)::INT, r, {label}) AS fill FROM {name}2),
    {name} AS (SELECT {keys}, CASE WHEN cap <= lv * w THEN cap ELSE floor(fill * w) END AS parent_budget FROM {name}3)"""


@query("op6_mixing", f"""
    WITH docs AS (SELECT doc_id, lang, source, 'd' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 4) AS domain,
                  CAST(len(coalesce(regexp_extract_all(text, '{WORD_SQL}'), [])) AS BIGINT) AS n_tokens FROM documents),
    sums AS (SELECT domain, lang, source, SUM(n_tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
    leaves AS (SELECT *, tokens * {MIX["max_epochs"]} AS cap FROM sums),
    root AS (SELECT floor(SUM(tokens) * {MIX["share"]}e0) AS parent_budget FROM sums),
    {_share_out_sql("a", "root", [], "domain", MIX_WEIGHTS[0])},
    {_share_out_sql("b", "a", ["domain"], "lang", MIX_WEIGHTS[1])},
    {_share_out_sql("c", "b", ["domain", "lang"], "source", MIX_WEIGHTS[2])},
    budgets AS (SELECT c.*, floor(parent_budget / tokens)::INT AS full_epochs, parent_budget - floor(parent_budget / tokens) * tokens AS rest
                FROM c JOIN sums s ON c.domain = s.domain AND c.lang IS NOT DISTINCT FROM s.lang AND c.source IS NOT DISTINCT FROM s.source WHERE parent_budget > 0),
    placed AS (SELECT *, coalesce(SUM(n_tokens) OVER (PARTITION BY domain, lang, source
                 ORDER BY md5('{MIX["seed"]}|' || full_epochs || '|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
               FROM docs JOIN (SELECT domain AS d, lang AS l, source AS s, full_epochs, rest, parent_budget FROM budgets)
               ON domain = d AND lang IS NOT DISTINCT FROM l AND source IS NOT DISTINCT FROM s)
    SELECT doc_id, lang, source, CAST(mix_epoch AS INT) AS mix_epoch, n_tokens AS mix_tokens, CAST(parent_budget AS BIGINT) AS mix_budget
    FROM (SELECT *, unnest(range(CASE WHEN before < rest THEN full_epochs + 1 ELSE full_epochs END)) AS mix_epoch FROM placed)""")
def mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "lang", "source", "mix_epoch", "mix_tokens", "mix_budget")


@query("op7_kd_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def kd_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return kdsearch.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


CONFLICTING = "</s>[INST] ok [/INST]"
_BACKSLASH = chr(92)


@query("op4_chat_format", f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '{CONFLICTING}'), (-7, 1, 'assistant', '{CONFLICTING}')),
    f AS (SELECT *, 3 + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 17 ELSE 16 + 2 * strlen(role) END
                 + length(regexp_replace(text, '({_BACKSLASH}{_BACKSLASH}*)({chat.CONTROL})', '{_BACKSLASH * 2}{_BACKSLASH}1{_BACKSLASH}2', 'g')) AS chars FROM t)
    SELECT conv_id, COUNT(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
           CAST(SUM(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id""")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONFLICTING), (-7, 1, "assistant", CONFLICTING)], turns.schema)
    chunks = landed(chat.format_conversations(turns.unionByName(more)), "chat")
    return chat.summaries(chunks).withColumnRenamed("conversation", "conv_id")


def _left_sql(depth: int) -> str:
    text = "t"
    for pattern in list(divergence.CLASSES.values())[:depth]:
        text = "regexp_replace({}, '{}', '', 'g')".format(text, pattern.replace("'", "''"))
    return text


def _distance_sql(name: str, size: int) -> str:
    """Jensen-Shannon distance of a document's counts to the sums of its language."""
    p, q = "(name[i] / psum)".replace("name", name), f"(ref_{name}[i] / qsum)"
    part = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
    terms = f"list_transform(range(1, {size + 1}), lambda i: {part.format(p, q)} + {part.format(q, p)})"
    terms = terms.replace("psum", f"list_sum({name})::DOUBLE").replace("qsum", f"list_sum(ref_{name})::DOUBLE")
    return f"CASE WHEN list_sum({name}) > 0 AND list_sum(ref_{name}) > 0 THEN sqrt(greatest(list_sum({terms}) / 2, 0)) END"


_N_CLASSES, _N_COMMON = len(divergence.CLASSES) + 1, len(divergence.COMMON) + 1
_COUNTS = ", ".join(f"CAST(len(l{i}) - len(l{i + 1}) AS BIGINT)" for i in range(len(divergence.CLASSES)))
_LISTED = "[" + ", ".join(f"'{w}'" for w in divergence.COMMON) + "]"
_SUMS = lambda name, size: "[" + ", ".join(f"SUM({name}[{i + 1}])" for i in range(size)) + f"] AS ref_{name}"


@query("op1_divergence", f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{WORD_SQL}') AS ws, {", ".join(f"{_left_sql(i)} AS l{i}" for i in range(_N_CLASSES))} FROM d),
    lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD_SQL}')) AS ls FROM d),
    win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM l)),
    twice AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING COUNT(*) > 1),
    covered AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, s), (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
    words AS (SELECT doc_id, w, COUNT(*) AS n FROM (SELECT doc_id, unnest(list_transform(ws, lambda x: lower(x))) AS w FROM l)
              WHERE list_contains({_LISTED}, w) GROUP BY ALL),
    counted AS (SELECT doc_id, map_from_entries(list((w, n))) AS m FROM words GROUP BY doc_id),
    f AS (SELECT l.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, [{_COUNTS}, CAST(len(l{_N_CLASSES - 1}) AS BIGINT)] AS classes,
                 CAST(len(t) - (len(l1) - len(l2)) AS BIGINT) AS word_chars,
                 CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
                 list_transform({_LISTED}, lambda w: CAST(coalesce(m[w], 0) AS BIGINT)) AS c
          FROM l JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN counted USING (doc_id)),
    h AS (SELECT *, list_append(c, n_words - CAST(list_sum(c) AS BIGINT)) AS common FROM f),
    refs AS (SELECT lang AS ref_lang, {_SUMS("classes", _N_CLASSES)}, {_SUMS("common", _N_COMMON)} FROM h GROUP BY lang),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_distance_sql("classes", _N_CLASSES)} AS dc,
                 {_distance_sql("common", _N_COMMON)} AS dw FROM h JOIN refs ON lang IS NOT DISTINCT FROM ref_lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (n_words >= {divergence.MIN_WORDS}
             AND (coalesce(dc, 0) > {divergence.MAX_CLASS_DISTANCE} OR coalesce(dw, 0) > {divergence.MAX_WORD_DISTANCE})) AS kept
    FROM j""")
def divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = divergence.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_TEMPLATE_SQL = ", ".join(f"({t}, '{label}', {place}, '{word}', {must})" for t, label, place, word, must in licences.ROWS + licences.WHOLE_ROWS)
_WORD_LIST_SQL = ", ".join(f"'{w}'" for w in licences.WORDS)


def _starts_sql(phrase: str, columns: str) -> str:
    """Places where the words of a phrase stand one after the other."""
    words = list(enumerate(phrase.split()))
    joins = " ".join(f"JOIN w b{n} ON b{n}.doc_id = a.doc_id AND b{n}.pos = a.pos + {n} AND b{n}.word = '{word}'" for n, word in words[1:])
    return f"SELECT {columns} FROM w a {joins} WHERE a.word = '{words[0][1]}'"


_STARTS_SQL = " UNION ALL ".join(_starts_sql(phrase, f"a.doc_id, a.pos, '{label}' AS label") for phrase, label in licences.PHRASES.items())
_WHOLE_SQL = " UNION ALL ".join(_starts_sql(phrase, f"a.doc_id, '{phrase}', a.pos") for phrase in licences.WHOLE)
_WHOLE_LIST_SQL = ", ".join(f"'{phrase}'" for phrase in licences.WHOLE)


@query("op9_licences", f"""
    WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{licences.UPPER}', '{licences.LOWER}'), '{licences.WORD[1:-1]}'), []) AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
    base AS ({_STARTS_SQL}),
    t AS (SELECT * FROM (VALUES {_TEMPLATE_SQL}) AS v(template, label, slot, word, mandatory)),
    hits AS (SELECT * FROM w WHERE word IN ({_WORD_LIST_SQL}) UNION ALL {_WHOLE_SQL}),
    freq AS (SELECT word, COUNT(DISTINCT doc_id) AS df FROM hits GROUP BY word),
    own AS (SELECT template, word, bool_or(mandatory) AS must FROM t WHERE word NOT IN ({_WHOLE_LIST_SQL}) GROUP BY ALL),
    rare AS (SELECT doc_id, template, word FROM (SELECT DISTINCT doc_id, word FROM hits) JOIN freq USING (word) JOIN own USING (word)
             QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, template ORDER BY must DESC, df, word) <= {licences.RARE_WORDS}),
    votes AS (SELECT doc_id, template, pos - slot AS off FROM hits JOIN rare USING (doc_id, word) JOIN t USING (template, word)
              GROUP BY ALL HAVING COUNT(DISTINCT word) >= {licences.MIN_VOTES}),
    laid AS (SELECT v.doc_id, v.template, t.label, v.off, t.mandatory, h.pos IS NOT NULL AS there,
                    CASE WHEN t.word IN ({_WHOLE_LIST_SQL}) THEN 0.0e0 ELSE ln((1.0e0 + (SELECT COUNT(*) FROM d)) / (1.0e0 + coalesce(df, 0))) END AS weight
             FROM votes v JOIN t USING (template) LEFT JOIN freq USING (word)
             LEFT JOIN hits h ON h.doc_id = v.doc_id AND h.pos = v.off + t.slot AND h.word = t.word),
    good AS (SELECT doc_id, label, CASE WHEN SUM(weight) > 0 THEN round(SUM(CASE WHEN there THEN weight ELSE 0 END) / SUM(weight), 6) ELSE 1.0 END AS score
             FROM laid GROUP BY doc_id, template, label, off HAVING bool_and(there OR NOT mandatory)),
    method AS (SELECT * FROM good WHERE score >= {licences.MIN_SCORE})
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, (SELECT COUNT(*) FROM base b WHERE b.doc_id = d.doc_id) AS n_base,
           (SELECT MIN(pos) FROM base b WHERE b.doc_id = d.doc_id) AS first_word, (SELECT MAX(pos) FROM base b WHERE b.doc_id = d.doc_id) AS last_word,
           coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base b WHERE b.doc_id = d.doc_id), '') AS base_labels,
           coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM method) b
                     WHERE b.doc_id = d.doc_id), '') AS labels,
           CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.doc_id = d.doc_id) THEN 1.0e0
                ELSE CAST(coalesce((SELECT MAX(score) FROM method m WHERE m.doc_id = d.doc_id), 0) AS DOUBLE) END AS score
    FROM d""")
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents").select("doc_id", "text"))


@query("op11_hard_negatives", """
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return negatives.hard_negatives(vectors, F.col("id") % 100 == 0, label=label)


# CRC-32 of the UTF-8 bytes of a text: the usual reflected polynomial, table made by eight shifts.
_CRC_TABLE_SQL = """
    bits AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
             FROM (SELECT unnest(range(0, 256)) AS n)),
    crc AS (SELECT list(c ORDER BY n) AS t FROM bits)"""
_BYTES_SQL = """flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
    ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"""
_RUN_SQL = f"{spelling.LETTERS}{{{spelling.MIN_LENGTH},}}"


@query("op12_spelling_variants", f"""
    WITH RECURSIVE {_CRC_TABLE_SQL},
    runs AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN_SQL}')) AS run FROM documents)),
    marked AS (SELECT run, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES_SQL.format("doc_id || ':' || run")}),
                      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h, length(run) AS size FROM runs, crc),
    w AS (SELECT word, COUNT(*) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word FROM marked)
          WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING COUNT(*) >= {spelling.MIN_COUNT}),
    cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
             UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN w ON w.word = c.rest
             UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN w ON w.word = c.rest),
    best AS (SELECT word, n, other, other_n, COUNT(*) OVER (PARTITION BY word) AS n_near FROM near
             QUALIFY ROW_NUMBER() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
                     CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
    way AS (SELECT word, word AS top FROM w UNION ALL SELECT way.word, form FROM way JOIN forms ON forms.word = top WHERE form IS NOT NULL)
    SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, f.form_n, way.top AS root
    FROM forms f JOIN way ON way.word = f.word JOIN forms last ON last.word = way.top AND last.form IS NULL""")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return spelling.group_variants(counts)


def _item_words_sql(table_name: str, key: str) -> str:
    lower = f"translate(text, '{winnowing.UPPER}', '{winnowing.LOWER}')"
    return f"SELECT {key}, coalesce(regexp_extract_all({lower}, '{winnowing.WORD[1:-1]}'), []) AS ws FROM {table_name}"


@query("op13_winnowing", f"""
    WITH d AS ({_item_words_sql("documents", "doc_id")}),
    b AS (SELECT item_id, ws, least(len(ws), {winnowing.WINDOW}) AS m FROM ({_item_words_sql("benchmark", "item_id")}) WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b)),
    dw AS (SELECT doc_id, i, m, array_to_string(ws[i : i + m - 1], ' ') AS s
           FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(ws) >= m)),
    hit AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
    cov AS (SELECT doc_id, COUNT(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
    its AS (SELECT doc_id, COUNT(*) AS n, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")
def winnowed(spark: SparkSession, folder: str) -> DataFrame:
    found = winnowing.decontaminate(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text")
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
