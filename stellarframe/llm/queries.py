"""The queries of the text operators, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, common, decontaminate, licenses, merkle, minhash, pieces, pii, quality_rules, shard, substrings, token_files


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.score(docs, classifier.fit(docs, common.table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    n = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, pii.BASE), F.sha2(pii.span_string("pii_base").cast("binary"), 256).alias("base_sha256"), pii.span_string("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"), F.array_max("pii_spans.score").alias("best_score"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    log = chat.conversation_log(rows.unionByName(added), deltas=3)
    return chat.digests(chat.format_conversations(log, dealt=True))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = licenses.find_licenses(common.table(spark, sf_dir, "documents"), keep=("doc_id",))
    text = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), text.alias("spans"), F.array_max("licenses.score").alias("best_score"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return pieces.round_trip(common.table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    judged = quality_rules.apply_rules(common.table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(common.table(spark, sf_dir, "documents"), 16)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    path = common.scratch(spark, "tokens")
    token_files.write_token_files(common.table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return token_files.id_digests(token_files.read_token_files(spark, path))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = decontaminate.find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(common.table(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    found = substrings.remove_repeated(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return found.select("doc_id", "n_bytes", substrings.removed_bytes("removed_spans").alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_OPERATORS = (
    op1_quality_classifier, op2_pii, op3_chat, op4_licenses, op5_pieces, op6_quality_rules, op7_shards, op8_token_files, op9_near_duplicates, op10_decontaminate, op11_merkle,
    op12_substrings,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

#: Windows of ten item words among all windows of the documents; SQL has no automaton, but equal results.
OP10_SQL = r"""
WITH w AS (SELECT item_id AS id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT id, least(len(words), 10) AS size, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS window_text FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g'), '[^ ]+') END AS words FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes WHERE len(words) >= size),
hits AS (SELECT r, i, places.size, id FROM places JOIN windows ON windows.size = places.size AND windows.window_text = array_to_string(places.words[i:i + places.size - 1], ' ')),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

#: Every pair of documents that share a shingle, then the links' transitive closure.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS words FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(words[i:i + least(len(words), 5) - 1], ' ') AS shingle, least(len(words), 5) AS size FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.size = y.size AND x.r <> y.r GROUP BY x.r, y.r),
links AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

#: What the template makes of a conversation: lengths grow by the marks and by one for each escaped backslash or `<|`.
OP3_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM rows),
f AS (SELECT *, '<|im_start|>' || replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS piece FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, k)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, k)) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""



def _op6_sql() -> str:
    """Counts by regular expressions, distances by their definition; the references are those of the operator."""
    q = quality_rules
    refs = ", ".join(f"('{g}', {i + 1}, {x / sum(shares)!r}::DOUBLE)" for g, shares in q.CLASS_REFERENCE.items() for i, x in enumerate(shares))
    common = ", ".join(f"('{g}', '{w}', {x!r}::DOUBLE)" for g, words in q.COMMON_WORDS.items() for w, x in zip([*words, ""], q.word_reference(g).tolist(), strict=True))
    blank, mark = r"[\x20\x09-\x0D]", "[.,;:!?''\"()-]"
    count = lambda p: f"length(regexp_replace(text, '[^{p}]', '', 'g'))"
    classes = [count("aeiou"), count("b-df-hj-np-tv-z"), r"length(regexp_replace(regexp_replace(text, '[A-Za-z]', '', 'g'), '[^\p{L}]', '', 'g'))", count("A-Z"), count("0-9"), count(blank[1:-1]), count(mark[1:-1])]
    half = "sum(CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END)"
    distance = f"sqrt(greatest(0.0::DOUBLE, ({half.format('p', 'q')} + {half.format('q', 'p')}) / 2))"
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 0) + 1)) AS i FROM w)),
twice AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (r, k)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
c7 AS (SELECT r, length(text) AS n, [{', '.join(classes)}] AS h FROM d),
c AS (SELECT r, n, list_append(h, n - list_sum(h)) AS h FROM c7 WHERE n > 0),
refs(g, i, q) AS (VALUES {refs}),
common(g, word, q) AS (VALUES {common}),
langs AS (SELECT r, g FROM d, (SELECT DISTINCT g FROM refs) WHERE lang = g OR lang IS NULL OR lang NOT IN (SELECT g FROM refs)),
cd AS (SELECT r, g, {distance} AS dist FROM (SELECT r, g, CAST(h[i] AS DOUBLE) / n AS p, q FROM c JOIN langs USING (r) JOIN refs USING (g)) GROUP BY r, g),
plain AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?"()]', '', 'g'), '[^\\x20\\x09-\\x0D]+')) AS word FROM d) GROUP BY r, word),
sizes AS (SELECT r, sum(n) AS n FROM plain GROUP BY r),
hits AS (SELECT r, g, word, q, coalesce(plain.n, 0) AS k FROM langs JOIN common USING (g) LEFT JOIN plain USING (r, word) WHERE word <> ''),
every AS (SELECT r, g, q, CAST(k AS DOUBLE) / sizes.n AS p FROM hits JOIN sizes USING (r) UNION ALL SELECT r, g, any_value(common.q), 1 - CAST(sum(k) AS DOUBLE) / any_value(sizes.n) FROM hits JOIN sizes USING (r) JOIN common USING (g) WHERE common.word = '' GROUP BY r, g),
wd AS (SELECT r, g, {distance} AS dist FROM every GROUP BY r, g),
m AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count("#*$%&|<>")} AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    (SELECT min(dist) FROM cd WHERE cd.r = d.r) AS cdist, coalesce((SELECT min(dist) FROM wd WHERE wd.r = d.r), CASE WHEN len(words) > 0 THEN 1.0::DOUBLE END) AS wdist FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(CASE WHEN n_words > 0 THEN cdist END, 6) AS class_distance, round(wdist, 6) AS word_distance,
    NOT base_failed AND NOT (n_words >= {q.MIN_JUDGED_WORDS} AND word_chars >= {q.MIN_JUDGED_CHARS} AND (cdist > {q.MAX_CLASS_DISTANCE} OR wdist > {q.MAX_WORD_DISTANCE})) AS kept FROM f
"""


#: The trees level by level, and each row's path to the root; crc32 by its table of 256 entries, made of its polynomial.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS v FROM bits),
d AS (SELECT row_number() OVER () AS r, * FROM documents),
made AS (SELECT r, doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z, CAST(n_chars AS HUGEINT) + 1 AS more,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS bad FROM d, crc),
leaves AS (SELECT r, doc_id, coalesce('=' || lang, '') AS tree, coalesce(bad, false) AS bad, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || z) AS leaf,
    sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(more AS VARCHAR)) || ':' || more END || z) AS changed FROM made),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM placed
    UNION ALL SELECT tree, level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, n, h FROM subroots UNION ALL SELECT level + 1, i // 2, any_value(n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
paths AS (SELECT r, tree, 0 AS level, i, n, CASE WHEN bad THEN changed ELSE leaf END AS h, '' AS proof FROM placed
    UNION ALL SELECT p.r, p.tree, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 0 THEN p.h || coalesce(s.h, '') ELSE s.h || p.h END), p.proof || coalesce(s.h, '')
        FROM paths p LEFT JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1),
up AS (SELECT r, 0 AS level, s.i, s.n, p.h, p.proof FROM paths p JOIN subroots s USING (tree) WHERE p.n = 1
    UNION ALL SELECT p.r, p.level + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN p.i % 2 = 0 THEN p.h || coalesce(s.h, '') ELSE s.h || p.h END), p.proof || coalesce(s.h, '')
        FROM up p LEFT JOIN tops s ON s.level = p.level AND s.i = xor(p.i, 1) WHERE p.n > 1)
SELECT doc_id, leaf, subroots.h AS subroot, tops.h AS root, sha256(proof) AS proof_sha256, up.h AS folded_root, up.h = tops.h AS verified FROM placed JOIN up USING (r) JOIN subroots USING (tree) JOIN tops ON tops.n = 1 WHERE up.n = 1
"""


#: Every window of 200 bytes by its digest.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT r, i, md5_number(x[i + 1:i + 200]) AS h FROM (SELECT r, x, unnest(range(octet_length(x) - 199)) AS i FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w WHERE h IN (SELECT h FROM twice)),
runs AS (SELECT r, i, count(CASE WHEN gap <= 200 THEN NULL ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM starts),
spans AS (SELECT r, k, min(i) AS a, max(i) + 200 AS e FROM runs GROUP BY r, k),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT r, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(CASE WHEN a > before THEN hex(x[before + 1:a]) ELSE '' END, '' ORDER BY a) || CASE WHEN max(e) < any_value(octet_length(x)) THEN hex(any_value(x)[max(e) + 1:any_value(octet_length(x))]) ELSE '' END AS kept FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CASE WHEN kept IS NULL THEN sha256(x) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""


ORACLE_SQL = {"op3_chat": OP3_SQL, "op6_quality_rules": _op6_sql(), "op9_near_duplicates": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_merkle": OP11_SQL, "op12_substrings": OP12_SQL}
