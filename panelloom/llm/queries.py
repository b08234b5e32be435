"""One query per operator over its whole table, and the SQL counterparts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import byte_bpe, chat, decontaminate, html_text, manifest, neighbours, packing, quality_votes, sharding, simhash, spelling, token_counts, warc
from panelloom.sources.tables import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: rendered length by template: marker lengths, and one character more for each control string and backslash escaped
OP1_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>\[INST\]|<</ROLE>>|<</SYS>>|<<ROLE:|\[/INST\]|<<SYS>>|\[INST\]|</s>|<s>|>>'))
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17 ELSE 20 + length(role) END AS size FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op1_chat_round_trip", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.render(given.union(extra)))


OP2_SQL = f"""
WITH words AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS grams
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), starts AS (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS grams
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows))
), found AS (
    SELECT doc_id, i, size, item_id FROM starts JOIN windows USING (size, grams)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op4_simhash_groups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_uniform_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.uniform_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op10_seekable_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to FROM d
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark.read.schema(warc.BUNDLE).parquet(path), payloads=False)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_embedding_groups")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_tiered_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.drop("ids")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op9_quality_votes")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_votes.score(docs, quality_votes.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_votes.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: unsigned CRC-32 of a short ASCII text, bit by bit
CRC32 = """xor(list_reduce(range(8 * length({0})), lambda crc, i: CASE WHEN xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr({0}, i::INT // 8 + 1, 1)) ELSE 0 END) & 1 = 1
    THEN xor(xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr({0}, i::INT // 8 + 1, 1)) ELSE 0 END) >> 1, 3988292384)
    ELSE xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr({0}, i::INT // 8 + 1, 1)) ELSE 0 END) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


OP12_SQL = f"""
WITH RECURSIVE digests AS (
    SELECT doc_id, lang, sha256({" || ".join(map(_field, manifest.FIELDS))}) AS leaf,
        CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 7 = 0 THEN sha256({" || ".join(_field(f if f != "n_chars" else "(n_chars + 1)") for f in manifest.FIELDS)}) END AS changed
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM digests
), up(lang, level, pos, size, node) AS (
    SELECT lang, 0, pos, size, leaf FROM ranked
    UNION ALL
    SELECT lang, level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY lang, level, pos // 2, size
), subroots AS (
    SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1
), over_groups(level, pos, size, node) AS (
    SELECT 0, pos, size, node FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (size + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM over_groups WHERE size > 1 GROUP BY level, pos // 2, size
), inner_steps AS (
    SELECT lang, row_id, level, place, node FROM (
        SELECT r.lang, r.pos AS row_id, u.level, r.pos >> u.level AS place FROM ranked r JOIN (SELECT DISTINCT lang, level, size FROM up WHERE size > 1) u ON u.lang IS NOT DISTINCT FROM r.lang
    ) s LEFT JOIN (SELECT lang AS other_lang, level AS other_level, pos AS other_pos, node FROM up) o ON other_lang IS NOT DISTINCT FROM lang AND other_level = level AND other_pos = xor(place, 1)
), outer_steps AS (
    SELECT lang, level, place, node FROM (
        SELECT s.lang, g.level, s.pos >> g.level AS place FROM subroots s, (SELECT DISTINCT level FROM over_groups WHERE size > 1) g
    ) s LEFT JOIN (SELECT level AS other_level, pos AS other_pos, node FROM over_groups) o ON other_level = level AND other_pos = xor(place, 1)
), steps AS (
    SELECT lang, row_id, level, place, node FROM inner_steps
    UNION ALL
    SELECT r.lang, r.pos, 1000 + o.level, o.place, o.node FROM ranked r JOIN outer_steps o ON o.lang IS NOT DISTINCT FROM r.lang
), ways AS (
    SELECT lang, row_id, list(CASE WHEN node IS NULL THEN '' WHEN place & 1 = 1 THEN 'L' || node ELSE 'R' || node END ORDER BY level) AS way FROM steps GROUP BY lang, row_id
), proofs AS (
    SELECT r.doc_id, r.leaf, r.changed, s.node AS subroot, (SELECT node FROM over_groups WHERE size = 1) AS root, coalesce(w.way, []) AS way
    FROM ranked r LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM r.lang AND w.row_id = r.pos JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
), folded AS (
    SELECT *, list_reduce(way, lambda h, step: CASE WHEN step[1] = 'L' THEN sha256(step[2:] || h) ELSE sha256(h || step[2:]) END, coalesce(changed, leaf)) AS folded_root FROM proofs
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda step: step[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), altered={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


OP13_SQL = """
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), keyed AS (
    SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k, count(*) AS times FROM runs GROUP BY ALL
), bits(byte, step, c) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), crc_table AS (SELECT byte, c FROM bits WHERE step = 8
), crcs(k, hexed, i, crc) AS (
    SELECT k, hex(encode(k)), 0, 4294967295::BIGINT FROM keyed
    UNION ALL
    SELECT k, hexed, i + 1, xor(crc >> 8, c) FROM crcs JOIN crc_table ON byte = xor(crc, ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT) & 255 WHERE 2 * i < length(hexed)
), hashed AS (
    SELECT run, times, xor(crc, 4294967295) AS h FROM keyed JOIN crcs USING (k) WHERE 2 * i = length(hexed)
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
    ) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), led(word, root) AS (
    SELECT word, form FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL
), ends AS (SELECT led.word, led.root FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN ends e USING (word)
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    place = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    return spelling.variants(found.select(F.when(h % 199 == 0, shorter).otherwise(F.col("run")).alias("word")))
