"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, lm, quality, simhash, token_files, toxicity, turns, urls, vectors, weighted
from .common import fold, held_out, scratch, table


def tokenizer() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame) -> DataFrame:
    rows = bpe.encode(docs, *tokenizer())
    return rows.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
win AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM pos, sizes WHERE i + m - 1 <= len(w)),
hit AS (SELECT doc_id, i, win.m, item_id FROM win JOIN iw USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.link_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fp(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("figure")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, total = lm.score_texts(docs, fold("doc_id", 5) != 1)
    return rows.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def op8_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.encode(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2, stops=".,;:!?", lower=True)
    rows = token_files.read_documents(spark, path)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


_NORMALISED = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: " + _NORMALISED.format("x") + "), lambda x: x <> '')"


def _op5_sql(conversations: str = "SELECT * FROM conversations") -> str:
    """Near and far sources by whole texts, paragraphs and lines, then by runs of lines."""
    sources = lambda name, own: f"""{name}_near AS (SELECT conv_id, h, min(turn) AS t FROM {own} WHERE h <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
{name}_far AS (SELECT h, list(struct_pack(c := conv_id, t := t) ORDER BY conv_id)[1:2] AS two FROM {name}_near GROUP BY h)"""  # noqa: E731
    place = lambda name: f"CASE WHEN {name}_near.t < q.turn THEN struct_pack(c := q.conv_id, t := {name}_near.t) END, list_filter({name}_far.two, lambda x: x.c <> q.conv_id)[1]"
    joins = " ".join(f"LEFT JOIN {k}_near ON {k}_near.conv_id = q.conv_id AND {k}_near.h = q.h LEFT JOIN {k}_far ON {k}_far.h = q.h" for k in ("whole", "run"))
    return rf"""
WITH given AS ({conversations}),
raw AS (SELECT conv_id, turn, role, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS ls FROM given),
marked AS (SELECT *, list_transform(ls, lambda x: regexp_extract(x, '^(?:[ \t]*>)+[ \t]?')) AS marks FROM raw),
lined AS (SELECT conv_id, turn, role, row, list_transform(range(1, len(ls) + 1), lambda i: CAST(length(marks[i]) - length(replace(marks[i], '>', '')) AS INTEGER)) AS levels,
  list_transform(range(1, len(ls) + 1), lambda i: substring(ls[i], length(marks[i]) + 1)) AS lines FROM marked),
plains AS (SELECT *, trim(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: levels[i] = 0 AND NOT (rtrim(lines[i]) LIKE '%wrote:' AND i < len(lines) AND coalesce(levels[i + 1], 0) > 0)), lambda i: lines[i]), chr(10)), chr(10)) AS plain,
  list_filter(range(1, len(lines) + 1), lambda i: levels[i] > 0 AND (i = 1 OR levels[i - 1] <> levels[i])) AS starts, list_filter(range(1, len(lines) + 1), lambda i: levels[i] > 0 AND (i = len(lines) OR levels[i + 1] <> levels[i])) AS stops FROM lined),
passages AS (SELECT conv_id, turn, k - 1 AS place, levels[starts[k]] AS level, array_to_string(lines[starts[k] : stops[k]], chr(10)) AS text FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS k FROM plains)),
quotes AS (SELECT DISTINCT conv_id, turn, level, place, {_NORMALISED.format("text")} AS h FROM passages),
own AS (SELECT conv_id, turn, {_NORMALISED.format("part")} AS h FROM (SELECT conv_id, turn, unnest(list_concat([plain], string_split_regex(plain, '\n\s*\n'), string_split(plain, chr(10)))) AS part FROM plains)),
sizes AS (SELECT DISTINCT len({_LINES.format("text")}) AS n FROM passages),
runs AS (SELECT conv_id, turn, array_to_string(ls[i : i + n - 1], ' ') AS h FROM (SELECT conv_id, turn, ls, n, unnest(range(1, len(ls) - n + 2)) AS i FROM (SELECT conv_id, turn, {_LINES.format("plain")} AS ls FROM plains), sizes WHERE n > 1 AND n <= len(ls))),
{sources("whole", "own")},
{sources("run", "runs")},
links AS (SELECT conv_id, turn, level, place, h, source.c AS sc, source.t AS st FROM (SELECT q.*, coalesce({place("whole")}, {place("run")}) AS source FROM quotes q {joins} WHERE q.h <> '') WHERE source IS NOT NULL),
best AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(st, (level, place)) FILTER (WHERE sc = conv_id) AS near_t, arg_min(sc, (level, place, sc, st)) AS any_c, arg_min(st, (level, place, sc, st)) AS any_t FROM links GROUP BY conv_id, turn),
told AS (SELECT p.conv_id, p.turn, role, row, plain, levels, len(starts) AS n, n_linked, near_t, any_c, any_t, max(p.turn) OVER (PARTITION BY p.conv_id ORDER BY p.turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM plains p LEFT JOIN best USING (conv_id, turn))
SELECT conv_id, turn, role, plain AS text, CAST(n AS INTEGER) AS n_quotes, CAST(coalesce(list_max(levels), 0) AS INTEGER) AS max_level, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
  CASE WHEN near_t IS NULL AND any_t IS NOT NULL THEN any_c WHEN coalesce(near_t, before) IS NOT NULL THEN conv_id END AS reply_conv, CASE WHEN near_t IS NULL AND any_t IS NOT NULL THEN any_t ELSE coalesce(near_t, before) END AS reply_turn,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(near_t, before) NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, plain) AS INTEGER) AS position FROM told
"""


OP5_SQL = _op5_sql()

#: `conversations` with quotes set into them, as the tables have none: of the message before, of two lines of the first
#: one under a nested mark, of the first one of the next conversation, and of nothing that was said.
PLANTED = """
SELECT c.conv_id, c.turn, c.role, CASE
  WHEN c.turn % 4 = 1 THEN concat('> ', coalesce(p.text, ''), chr(10), coalesce(c.text, ''))
  WHEN c.turn % 4 = 2 THEN concat('Someone wrote:', chr(10), '>> ', split_part(coalesce(z.text, ''), chr(10), 2), chr(10), '> > ', split_part(coalesce(z.text, ''), chr(10), 3), chr(10), '> ', replace(split_part(coalesce(p.text, ''), chr(10), 1), ' ', '   '), chr(10), coalesce(c.text, ''))
  WHEN c.turn % 4 = 3 THEN concat(coalesce(c.text, ''), chr(10), '>  ', split_part(coalesce(x.text, ''), chr(10), 1), chr(10), 'so far', chr(10), '> nobody said this')
  ELSE c.text END AS text
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 LEFT JOIN conversations z ON z.conv_id = c.conv_id AND z.turn = 0
LEFT JOIN conversations x ON x.conv_id = c.conv_id + 1 AND x.turn = 0
"""


def planted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over conversations that do quote."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("planted_conversations")
    return chat.link_quotations(spark.sql(PLANTED.replace("conversations ", "planted_conversations ")))


def _op4_sql() -> str:
    """Rules by length, and the two models level by level."""
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{value(kind, h, p)}'" for kind, h, p in ranked) + " END"
    n, pull, share = urls.ORDER, urls.PULL, 1.0 / len(urls.SYMBOLS)
    levels = [f"m0 AS (SELECT gram, (a + {pull * share}) / (ta + {pull}) AS pa, (r + {pull * share}) / (tr + {pull}) AS pr FROM level WHERE k = 0)"]
    levels += [f"m{k} AS (SELECT l.gram, (a + {pull} * pa) / (ta + {pull}) AS pa, (r + {pull} * pr) / (tr + {pull}) AS pr FROM level l JOIN m{k - 1} s ON substring(l.gram, 2) = s.gram WHERE k = {k})" for k in range(1, n + 1)]
    joins = " ".join(f"LEFT JOIN m{k} ON m{k}.gram = substring(padded, i - {k}, {k + 1})" for k in range(n + 1))
    best = ", ".join(f"ln(m{k}.pa) - ln(m{k}.pr)" for k in range(n, -1, -1))
    return rf"""
WITH host AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {cases(lambda kind, h, p: h + p)} AS rule, {cases(lambda kind, h, p: kind)} AS ruled,
  regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0./:\-_?=&#%+~]', '*', 'g') AS symbols FROM host),
u AS (SELECT url, '{"^" * n}' || min(symbols) AS padded, min(ruled) AS ruled, substring(md5(url), 1, 1) < '4' AS tests FROM ruled WHERE url IS NOT NULL GROUP BY url),
spots AS (SELECT *, unnest(range({n + 1}, length(padded) + 1)) AS i FROM u),
grams AS (SELECT ruled = 'allow' AS accepted, k, substring(padded, i - k, k + 1) AS gram FROM spots, range({n + 1}) t(k) WHERE ruled IS NOT NULL AND NOT tests),
counts AS (SELECT k, gram, count(*) FILTER (WHERE accepted) AS a, count(*) FILTER (WHERE NOT accepted) AS r FROM grams GROUP BY k, gram),
totals AS (SELECT k, substring(gram, 1, k) AS context, sum(a) AS ta, sum(r) AS tr FROM counts GROUP BY 1, 2),
level AS (SELECT c.k, gram, a, r, ta, tr FROM counts c JOIN totals t ON c.k = t.k AND substring(gram, 1, c.k) = context WHERE ta + tr >= {urls.MIN_CONTEXT} OR c.k = 0),
{", ".join(levels)},
figures AS (SELECT url, avg(coalesce({best}, 0)) * (SELECT CAST(count(DISTINCT ruled) = 2 AS INTEGER) FROM u WHERE NOT tests) AS figure FROM spots {joins} GROUP BY url),
bins AS (SELECT CAST(round(figure * 50) AS INTEGER) AS b, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS r FROM u JOIN figures USING (url) WHERE tests AND ruled IS NOT NULL GROUP BY 1),
edges AS (SELECT b, lag(b, 1, b - 1) OVER (ORDER BY b) AS last, coalesce(sum(a) OVER before, 0) / greatest(1, sum(a) OVER ()) + (sum(r) OVER () - coalesce(sum(r) OVER before, 0)) / greatest(1, sum(r) OVER ()) AS errors FROM bins WINDOW before AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT CAST(b + last AS DOUBLE) / 100 FROM edges ORDER BY errors, b LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(figure, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM ruled LEFT JOIN figures USING (url), cut
"""


def _op11_sql() -> str:
    """The rounds one after the other, every part held against every entry."""
    near = lambda k: f"near{k} AS MATERIALIZED (SELECT row, p, arg_min(e, apart * 256 + e) AS e, min(apart) AS apart FROM (SELECT row, parts.p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS apart FROM parts JOIN book{k} ON book{k}.p = parts.p) GROUP BY row, p)"
    book = lambda k: f"""sums{k} AS (SELECT p, e, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS place FROM parts JOIN near{k} USING (row, p)) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY place) AS c FROM sums{k} GROUP BY p, e) m USING (p, e))"""  # noqa: E731
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
book0 AS (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= 256),
{", ".join(f"{near(k)}, {book(k)}" for k in range(4))}, {near(4)},
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4),
coded AS (SELECT row, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(apart) AS BIGINT) AS error FROM near4 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest
"""


def _op12_sql() -> str:
    """The forward pass as a recursion over rows, its four states as columns of (cost, audit, repaired text)."""
    made = lambda s, cost, letter, line="''": f"CASE WHEN {s} IS NOT NULL THEN struct_pack(c := {s}.c + {cost}, a := {s}.a || '{letter}', t := {s}.t || {line}) END"
    insert = lambda s, role: made(s, 5, "I", f"(chr(10) || '{role}:')")
    keep = lambda s, initial: f"CASE WHEN NOT go AND initial = '{initial}' THEN {made(s, '5 * cut', 'K', '(chr(10) || role || chr(58) || text)')} END"
    rerole = lambda s, role: f"CASE WHEN NOT go THEN {made(s, '(1 + 5 * cut)', 'R', f'(chr(10) || {chr(39)}{role}:{chr(39)} || text)')} END"
    to_u = [f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))]
    return rf"""
WITH RECURSIVE bytes AS (SELECT DISTINCT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bits AS (SELECT conv_id, turn, (xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT)), lambda c, x: list_reduce(range(8), lambda b, j: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295)) % 20 AS fault FROM bytes),
damaged AS (SELECT c.conv_id, c.turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations c JOIN bits b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.turn IS NOT DISTINCT FROM c.turn WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, substring(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank FROM placed),
faults AS MATERIALIZED (SELECT *, blank OR again AS go, CAST(NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS INTEGER) AS cut,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM told),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := 0, a := '', t := '') AS s0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1, struct_pack(c := 5, a := 'I', t := chr(10) || 'user:') AS s2, struct_pack(c := 10, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, {insert("s2", "assistant")}]) AS s3 FROM (
    SELECT conv_id, i, s0, s1, list_min([s2, {insert("s0", "user")}, {insert("s1", "user")}, {insert("s3", "user")}]) AS s2, s3 FROM (
      SELECT w.conv_id, f.i, {made("s0", 2, "D")} AS s0, list_min([{made("s1", 2, "D")}, {keep("s0", "s")}]) AS s1, list_min([{made("s2", 2, "D")}, {", ".join(to_u)}]) AS s2, list_min([{made("s3", 2, "D")}, {keep("s2", "a")}, {rerole("s2", "assistant")}]) AS s3
      FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
ends AS (SELECT conv_id, list_min([s0, s3]) AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE go AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substring(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_chat_quotes": op5_chat_quotes,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_weighted_fingerprint": op8_weighted_fingerprint,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_vector_codes": op11_vector_codes,
    "op12_turn_repair": op12_turn_repair,
    "op13_token_files": op13_token_files,
    "planted_quotes": planted_quotes,
}
ORACLE_SQL = {"op3_decontaminate": OP3_SQL, "op4_url_filter": _op4_sql(), "op5_chat_quotes": OP5_SQL, "op11_vector_codes": _op11_sql(), "op12_turn_repair": _op12_sql(), "planted_quotes": _op5_sql(PLANTED)}
