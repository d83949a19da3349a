"""Registered queries of the text operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontam, language, licences, merkle, neardup, negatives, pages, pieces, quality, sharding, tokens, vectors
from .common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

END_ID = 2


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers
    return tokens.token_files(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def _sql_canonical(text: str) -> str:
    body = f"regexp_replace({text}, '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    body = f"' ' || regexp_replace(lower({body}), '{licences.NOT_WORD}', '  ', 'g') || ' '"
    for other, usual in licences.SPELLINGS.items():
        body = f"replace({body}, '{licences.spaced(other)}', '{licences.spaced(usual)}')"
    return f"trim({body})"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP2_SQL = f"""
WITH known AS (
  SELECT sha256({_sql_canonical('notice')}) AS digest, min(spdx) AS text_licence
  FROM (VALUES {', '.join(f"({_sql_text(k)}, {_sql_text(t)})" for k, v in licences.NOTICES.items() for t in v)}) AS v(spdx, notice) GROUP BY 1),
forms AS (SELECT doc_id, {_sql_canonical('text')} AS form FROM documents),
wholes AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms),
lines AS (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, string_agg(DISTINCT text_licence, ',' ORDER BY text_licence) AS line_licences, count(*) AS n FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, text_licence, coalesce(line_licences, '') AS line_licences, coalesce(n, 0) AS n_licence_lines
FROM wholes LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""


@query("op2_licences", OP2_SQL)
def licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf, "documents"))


OP4_SQL = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
bench AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM cut WHERE kind = 'b' AND len(w) > 0)),
places AS (
  SELECT id AS doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM cut, (SELECT DISTINCT n FROM bench) WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, n, p, item_id FROM places JOIN bench USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT word_at) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word_at FROM (SELECT DISTINCT doc_id, n, p FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN hit_words ON id = hit_words.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 'd'
"""


@query("op4_decontamination", OP4_SQL)
def decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


PROBE_TEXT = r"\### Assistant: </turn> ok"


def _sql_escape(text: str) -> str:
    for head, tail in chat.CONTROLS:
        text = rf"regexp_replace({text}, '{head}(\\*){tail}', '{head}\\\1{tail}', 'g')"
    return text


def _sql_role(role: str) -> str:
    for mark, code in chat.ROLE_CODES.items():
        char = "chr(10)" if mark == "\n" else f"'{mark}'"
        role = f"replace({role}, {char}, '{code}')"
    return role


OP7_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || {_sql_role('role')} || ': ' || {_sql_escape('text')} || '</turn>' || chr(10)))::BIGINT AS formatted_chars, true AS identical
FROM turns GROUP BY conv_id
"""


@query("op7_chat", OP7_SQL)
def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(
        *[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE_TEXT).alias("text"))
          for i, role in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


@query("op3_quality")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= quality.KEEP_FROM, 1).otherwise(0).alias("predicted"))


@query("op8_language")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.learn_dictionaries(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


OP5_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(3, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM cut WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * p.n >= 85 * (s.n + t.n - p.n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM cut UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT c.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, c.doc_id = r.component_id AS kept
FROM cut c LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query("op5_near_duplicates", OP5_SQL)
def near_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


@query("op10_main_text")
def main_texts(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_text(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_nearest")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op9_pieces")
def piece_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to it."""
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    text_key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = table(spark, sf, "documents").select("doc_id", "text", text_key.alias("text_sha256"))
    encoded = pieces.encode(docs, path, ("doc_id", "text_sha256"))
    named = encoded.withColumn("n_pieces", F.size("pieces").cast("long"))
    back = pieces.decode(named, path, ("doc_id", "n_pieces", "text_sha256"))
    return back.select("doc_id", "n_pieces", F.col("ids_sha256").alias("pieces_sha256"), (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip"))


#: The table of the reflected CRC-32 polynomial by its rule, as a list in a one-row relation ``crc_table(t)``.
SQL_CRC_TABLE = f"""crc_table AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END, i)) AS t)"""


def _sql_crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``t`` of crc_table must be in scope."""
    every = (1 << 32) - 1
    bytes_of = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), {every}), {every})"


SHARDS = 40
OP13_SQL = f"""
WITH {SQL_CRC_TABLE},
sized AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, coalesce(strlen(text), 0) + 16 AS size, {_sql_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
told AS (SELECT *, md5('{sharding.SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || text_crc32 || '|' || size) AS digest,
  ('0x' || substr(md5('{sharding.SEED}|' || tree), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS phase FROM sized),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY tree ORDER BY digest) - 1 + phase) / count(*) OVER (PARTITION BY tree) AS fraction FROM told),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, tree, digest) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * {SHARDS} // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, place - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM cut
"""


@query("op13_shards", OP13_SQL)
def shard_places(spark: SparkSession, sf: str) -> DataFrame:
    data = F.coalesce("text", F.lit(""))
    sized = table(spark, sf, "documents").select("doc_id", "source", (F.octet_length(data) + 16).cast("long").alias("size"),
                                                 F.crc32(data.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave(sized, SHARDS, identity=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _sql_leaf(text: str) -> str:
    values = [text if f == "text" else f"{f}::VARCHAR" for f in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_sql_leaf("text")} AS leaf,
    CASE WHEN {_sql_crc("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS shown FROM documents, crc_table),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3, n),
subroots AS MATERIALIZED (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3, n),
whole AS MATERIALIZED (
  SELECT tree, level, place, digest, n FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.height + t.level, t.place, t.digest, t.n FROM subroots s, tops t WHERE t.n > 1),
paths AS (
  SELECT p.tree, p.place AS leaf_place, 0 AS level, CASE WHEN height = 0 THEN s.place ELSE p.place END AS place, CASE WHEN height = 0 THEN s.n ELSE p.n END AS n,
    height, s.place AS tree_place, s.n AS trees FROM placed p JOIN subroots s USING (tree)
  UNION ALL
  SELECT tree, leaf_place, level + 1, CASE WHEN level + 1 = height THEN tree_place ELSE place // 3 END,
    CASE WHEN level + 1 = height THEN trees ELSE (n + 2) // 3 END, height, tree_place, trees FROM paths WHERE n > 1),
steps AS MATERIALIZED (
  SELECT p.tree, p.leaf_place, p.level, coalesce(string_agg(w.digest, '' ORDER BY w.place) FILTER (w.place < p.place), '') AS before,
    coalesce(string_agg(w.digest, '' ORDER BY w.place) FILTER (w.place > p.place), '') AS after
  FROM paths p JOIN whole w ON w.tree = p.tree AND w.level = p.level AND w.place // 3 = p.place // 3 GROUP BY p.tree, p.leaf_place, p.level, p.place),
folds AS (
  SELECT tree, place AS leaf_place, 0 AS level, shown AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.leaf_place, f.level + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s USING (tree, leaf_place, level)),
ends AS (SELECT tree, leaf_place, arg_max(digest, level) AS folded_root FROM folds GROUP BY ALL),
proofs AS (SELECT tree, leaf_place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY ALL),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN root r JOIN ends e ON e.tree = p.tree AND e.leaf_place = p.place
LEFT JOIN proofs q ON q.tree = p.tree AND q.leaf_place = p.place
"""


@query("op12_manifest", OP12_SQL)
def manifest_proofs(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of all leaves, folded from texts of which half have lost their line ends."""
    docs = table(spark, sf, "documents")
    values = [F.col(f) for f in LEAF_FIELDS]
    cut = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in LEAF_FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select(F.col("source").alias("tree"), "doc_id", merkle.leaf_digest(*values).alias("digest"), F.when(hit, merkle.leaf_digest(*cut)).alias("tampered"))
    proved = merkle.manifest(leaves, ["doc_id"], ("doc_id", "tampered")).proofs()
    shown = proved.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                          merkle.folded(F.coalesce("tampered", "digest"), F.col("proof")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = o.label AS alike, o.vec_id, list_inner_product(a.x, o.x)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 3
"""


@query("op11_hard_negatives", OP11_SQL)
def hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives after one label in seven has moved on by one."""
    label = F.col("label").cast("long")
    moved = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(moved, F.col("vec_id") % 50 == 0)
