"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.llm import (
    chat,
    hard_negatives,
    langid,
    language_model,
    mixing,
    neighbours,
    packing,
    quality,
    repeats,
    sharding,
    simhash,
    spelling,
    toxicity,
)
from edspark.llm.common import remainder, ship, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return register


_W = r"'[^\x20\x09-\x0D]+'"


_LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_W}) AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_W})) AS ls FROM d),
g AS (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS a FROM w),
g3 AS (SELECT rid, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM g WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS c FROM g3 WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
             length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
             CASE WHEN regexp_matches(t, '\p{{L}}') THEN 1 ELSE 0 END AS n_letter_runs
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END)
        + (CASE WHEN 100 * n_upper > 50 * word_chars THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
        + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 64 ELSE 0 END)
        + (CASE WHEN 100 * n_bullet_lines > 90 * n_lines THEN 128 ELSE 0 END)
        + (CASE WHEN 100 * n_ellipsis_lines > 30 * n_lines THEN 256 ELSE 0 END)
        + (CASE WHEN n_letter_runs = 0 THEN 512 ELSE 0 END) AS failed_bits FROM m)
"""


@query("op1_quality_rules", _LEDGER + r"""
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (failed_bits & 639) = 0 AS kept, failed_bits::BIGINT AS failed_bits FROM b
""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored ledger of every document, the verdict of the base rules and of
    the current policy (which contains them)."""
    led = quality.write_ledger(table(spark, sf_dir, "documents"))
    bits = F.col("ledger.failed_bits")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return led.select("doc_id", *[F.col(f"ledger.{k}").alias(k) for k in names],
                      (~quality.passes(bits, quality.BASE)).alias("base_failed"),
                      quality.passes(bits, quality.CURRENT).alias("kept"), bits.alias("failed_bits"))


_RULES_OF = ", ".join(f"('{p}', '{r}', {quality.mask_of(p)}, {1 << quality.RULE_NAMES.index(r)})"
                      for p, names in quality.POLICIES.items() for r in names)


@query("quality_ablations", _LEDGER + f""", p(policy, rule, mask, bit) AS (VALUES {_RULES_OF})
SELECT policy, rule, count(*)::BIGINT AS n_docs, (count(*) FILTER (WHERE (failed_bits & bit) <> 0))::BIGINT AS n_failed,
       (count(*) FILTER (WHERE (failed_bits & mask) = bit))::BIGINT AS n_failed_only,
       (count(*) FILTER (WHERE (failed_bits & mask) = 0))::BIGINT AS n_kept,
       (count(*) FILTER (WHERE (failed_bits & (mask - bit)) = 0))::BIGINT AS n_kept_without
FROM b, p GROUP BY policy, rule
""")
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does in each versioned policy, from the stored bits."""
    led = quality.write_ledger(table(spark, sf_dir, "documents"))
    return quality.ablations(led.select("ledger.failed_bits"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from the labels of those whose
    remainder is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    out = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), toxicity.score(docs, model, text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_block_nearest_neighbours", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
""")
def op3_block_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op4_recurrent_lm")
def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every whole document, learnt from those whose
    remainder is not 1."""
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, remainder("doc_id", 5) != 1)


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (3-word shingles) and component (links of 3 or fewer
    differing bits) of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_ESCAPED = "replace(coalesce({0}, ''), '\\', '\\\\')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"


@query("op6_reply_trees", f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
        12 + length(replace({_ESCAPED.format('role')}, chr(10), '\\' || chr(10))) + 1
        + length({_ESCAPED.format('text')}) + 11 AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(chars) AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
""")
def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are control strings, as a
    reply tree, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    done = chat.format_paths(chat.paths(chat.linear_messages(rows.unionByName(extra))))
    return done.select(F.col("name").alias("conv_id"), chat.digests(F.col("formatted"), F.col("loss_spans")).alias("d")).select(
        "conv_id", "d.*")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")


def _bisection(name: str, test: str) -> str:
    """Thirty steps; ``test`` is over the weights' entropy h and the largest
    weight over share, top."""
    return f"""{name}(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN {test} THEN mid ELSE low END, CASE WHEN {test} THEN high ELSE mid END
  FROM (SELECT i, low, high, mid, n, ln(z) - zl / z AS h, top / z AS top FROM (
    SELECT i, low, high, n, (low + high) / 2 AS mid,
           list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2))) AS z,
           list_sum(list_transform(p, lambda x: pow(x, (low + high) / 2) * ((low + high) / 2) * ln(x))) AS zl,
           list_max(list_transform(p, lambda x: pow(x, (low + high) / 2 - 1))) AS top
    FROM {name}, shares WHERE i < 30)))"""


@query("op8_temperature_mixing", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_W})) + 1 AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k FROM documents),
t AS (SELECT source, sum(size) AS tokens FROM d GROUP BY source),
tot AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM t),
shares AS (SELECT list(tokens / total) AS p, any_value(n) AS n FROM t, tot),
{_bisection('by_entropy', 'h >= 0.95 * ln(n)')},
{_bisection('by_repeats', 'top > 4')},
ends AS (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) AS h1, n, p FROM shares),
a1 AS (SELECT CASE WHEN h1 >= 0.95 * ln(n) THEN 1.0::DOUBLE ELSE (SELECT low FROM by_entropy WHERE i = 30) END AS a, p FROM ends),
a2 AS (SELECT CASE WHEN list_max(list_transform(p, lambda x: pow(x, a - 1))) / list_sum(list_transform(p, lambda x: pow(x, a))) > 4
            THEN (SELECT low FROM by_repeats WHERE i = 30) + pow(2.0::DOUBLE, -30) ELSE a END AS a, p FROM a1),
w AS (SELECT source, tokens, pow(tokens / total, a) / list_sum(list_transform(p, lambda x: pow(x, a))) AS weight, total
      FROM t, tot, a2),
q AS (SELECT *, round(weight * total)::BIGINT AS quota, round(weight * total)::BIGINT // tokens::BIGINT AS whole,
             ceil(tokens / greatest(100000, ceil(total / 10000)))::BIGINT AS n_blocks FROM w),
placed AS (SELECT d.*, weight, whole, quota - whole * tokens AS rest, ('0x' || substr(k, 1, 8))::BIGINT % n_blocks AS block
           FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, block, any_value(whole) AS whole, any_value(rest) AS rest, sum(size) AS tokens FROM placed GROUP BY source, block),
b2 AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY md5('mix-1|block|' || whole || '|' || block), block
                                   ROWS UNBOUNDED PRECEDING) - tokens AS before FROM b),
x AS (SELECT p.*, b2.before, b2.tokens, md5('mix-1|' || p.whole || '|' || k) AS h
      FROM placed p JOIN b2 ON p.source IS NOT DISTINCT FROM b2.source AND p.block = b2.block),
y AS (SELECT *, sum(size) OVER (PARTITION BY source, block ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto FROM x),
o AS (SELECT *, unnest(range(whole + CASE WHEN before + tokens <= rest OR (before < rest AND upto <= rest - before)
                                          THEN 1 ELSE 0 END)) AS epoch FROM y)
SELECT doc_id, source, size::BIGINT AS n_tokens, round(weight, 9) AS weight, epoch::INTEGER AS epoch, block::BIGINT AS block,
       (row_number() OVER (PARTITION BY source ORDER BY epoch, md5('mix-1|block|' || epoch || '|' || block), block,
                           md5('mix-1|' || epoch || '|' || k), doc_id) - 1)::BIGINT AS position
FROM o
""")
def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a document in the mixture of all sources: 95 % of
    the largest entropy, at most four epochs, the input's tokens as budget."""
    out = mixing.realise(table(spark, sf_dir, "documents"), mixing.Mixture())
    return out.withColumn("weight", F.round("weight", 9))


TOKENIZER = "byte_bpe_50k.json"


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


SHARDS = 40


@query("op10_jump_sharding", """
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS t,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16))::UBIGINT::HUGEINT AS h FROM documents),
jump(rid, n, state, landing, ahead) AS (
  SELECT rid, n, h, 0::BIGINT, 0::BIGINT FROM d, (VALUES (40), (41)) v(n)
  UNION ALL
  SELECT rid, n, s, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((s // 8589934592)::DOUBLE + 1.0::DOUBLE)))::BIGINT
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jump WHERE ahead < n)),
landed AS (SELECT rid, n, max(landing) AS shard FROM jump GROUP BY rid, n),
-- CRC-32 by its definition, a byte at a time, over a table of 256 remainders made here.
bytes AS (SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS tab FROM bytes WHERE k = 8),
crcs AS (SELECT rid, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(rtrim(regexp_replace(hex(encode(t)), '(..)', '\\1 ', 'g')), ' '),
                                            lambda y: coalesce(try_cast('0x' || y AS BIGINT), -1))),
    lambda acc, x: CASE WHEN x < 0 THEN acc ELSE xor(acc >> 8, tab[(xor(acc, x) & 255) + 1]) END), 4294967295) AS crc
  FROM d, crc_table)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, a.shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY a.shard ORDER BY CASE WHEN h >= 9223372036854775808
            THEN h - 18446744073709551616 ELSE h END, doc_id, size, crc) - 1)::BIGINT AS slot, b.shard::INTEGER AS grown_shard
FROM d JOIN crcs USING (rid) JOIN landed a ON a.rid = d.rid AND a.n = 40 JOIN landed b ON b.rid = d.rid AND b.n = 41
""")
def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and the shard after one more is appended, for every
    document."""
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op11_spelling_variants", r"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS run FROM d),
r AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
-- CRC-32 by its definition, a byte at a time, over a table of 256 remainders made here.
bytes AS (SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY b) AS tab FROM bytes WHERE k = 8),
checked AS (SELECT run, n, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(rtrim(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\1 ', 'g')), ' '),
                                            lambda y: ('0x' || y)::BIGINT)),
    lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1])), 4294967295) AS h FROM r, crc_table),
edited AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                       ELSE run END AS word, n FROM checked),
w AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS b FROM x),
near AS (SELECT p.word, q.word AS other, q.n AS other_n FROM cut p JOIN cut q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word
  UNION SELECT p.word, q.word, q.n FROM cut p JOIN w q ON q.word = p.a || p.b
  UNION SELECT q.word, p.word, p.n FROM cut p JOIN w q ON q.word = p.a || p.b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.other_n >= 5 * w.n THEN k.other END AS form,
             CASE WHEN k.other_n >= 5 * w.n THEN k.other_n END AS form_n FROM w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1),
walk(word, here) AS (SELECT word, word FROM f UNION ALL SELECT k.word, f.form FROM walk k JOIN f ON f.word = k.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.here AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM f JOIN walk k ON k.word = f.word JOIN f last ON last.word = k.here AND last.form IS NULL
""")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, and the form that each is a
    variant of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
c AS (SELECT vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS x FROM v),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
      FROM c a JOIN c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every anchor."""
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", shifted.alias("label"), "embedding"), F.col("id") % 100 == 0)


@query("op13_repeated_passages")
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that
    occur again."""
    return repeats.digests(table(spark, sf_dir, "documents"))
