"""The operators' registered queries: thin calls over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate_perspectives
from .decontaminate import decontaminate
from .extract import extract, train
from .fingerprint import fingerprints
from .jaccard import jaccard_join
from .language import fit, held_out, identify
from .lines import dedup_lines
from .resample import resample
from .sentencepiece_fst import decode, encode
from .sharding import BUCKETS, COPIES, grown, layout, shard
from .shared import small_batches
from .substrings import dedup_substrings
from .token_alignment import alignment_scores
from .walsh_codes import ENTRIES, PARTS, ROUNDS, SCALE, kept
from .walsh_codes import encode as encode_vectors
from .walsh_codes import fit as fit_codebooks


#: The public vocabularies that the tokeniser queries use.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_th")


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("_th", "_g")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op8_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = VOCABULARY) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file), model_file)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), layout(SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    book = fit_codebooks(rows)
    if book is None:
        out = kept(rows).select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")])
    else:
        out = encode_vectors(rows, book)
    return out.withColumn("codebooks_sha256", F.lit(book.sha256() if book else ""))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, VOCABULARY)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win USING (k, s)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS body,
         CASE WHEN role IS NULL THEN '<|user|>'
              ELSE '<|user name=' || replace(replace(replace(role, '\', '\\'), '|', '\|'), chr(10), '\n') || '|>' END AS head FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t),
r AS (
  SELECT t.conv_id, participant, turn, role, body, role IS NOT DISTINCT FROM participant AS own,
         CASE WHEN role IS NOT DISTINCT FROM participant THEN '<|assistant|>' ELSE head END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, body
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS said_at FROM r)
SELECT conv_id, participant, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_target_turns,
       string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, body) AS rendered,
       string_agg(said_at || '-' || (said_at + length(body)), ',' ORDER BY said_at, length(body)) FILTER (WHERE own) AS mask
FROM s GROUP BY 1, 2
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = d.doc_id
"""

def _sharding_sql() -> str:
    """The same tree as nested draws, and the checksum byte by byte, with a table made by its rule."""
    crc = list(range(256))
    for _ in range(8):
        crc = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in crc]

    def draw(children: list[tuple[str, float, str]]) -> str:
        u = lambda name: f"(('0x' || substr(md5(key || '|{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE"
        one = ", ".join(f"{{'d': -ln({u(name)}) / {w}::DOUBLE, 'i': {i}, 'v': {v}}}" for i, (name, w, v) in enumerate(children))
        return f"list_min([{one}]).v" if len(children) > 1 else children[0][2]

    def descend(tree, name: str) -> str:
        weigh = lambda rack: sum(rack.values())
        region = draw([(r, sum(map(weigh, racks.values())), f"'{r}'") for r, racks in tree.items()])
        rack = " ".join(f"WHEN '{r}' THEN {draw([(f'{r}/{k}', weigh(v), f"'{k}'") for k, v in racks.items()])}" for r, racks in tree.items())
        shards = [(f"{r}/{k}", v) for r, racks in tree.items() for k, v in racks.items()]
        last = " ".join(f"WHEN '{path}' THEN {draw([(f'{path}/{s}', w, str(s)) for s, w in v.items()])}" for path, v in shards)
        return f"""{name}_region AS MATERIALIZED (SELECT *, {region} AS r FROM base),
{name}_rack AS MATERIALIZED (SELECT *, CASE r {rack} END AS k FROM {name}_region),
{name} AS MATERIALIZED (SELECT id, r, k, (CASE r || '/' || k {last} END)::INT AS s FROM {name}_rack)"""

    tree = layout(SHARDS)
    return f"""
WITH base AS MATERIALIZED (SELECT rowid AS id, doc_id, text, coalesce(doc_id::VARCHAR, '') AS key FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
{descend(tree, "here")},
{descend(grown(tree), "later")},
sized AS (
  SELECT id, doc_id, key, (coalesce(strlen(text), 0) + 1)::BIGINT AS size,
         list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                     lambda c, b: xor(c >> 8, {crc}[1 + (xor(c, b) & 255)])) AS crc FROM base),
told AS (SELECT id, doc_id, key, size, xor(crc, 4294967295)::BIGINT AS text_crc32 FROM sized),
parts AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {COPIES} AS part FROM told),
bucket AS (SELECT *, substr(md5(key || '|' || size || '|' || text_crc32 || '|' || part), 1, {len(f"{BUCKETS - 1:x}")}) AS b FROM parts)
SELECT doc_id, size, text_crc32, 'key' AS law, here.s AS shard, later.s AS grown_shard, here.r AS region, here.k AS rack,
       row_number() OVER (PARTITION BY here.s ORDER BY b, doc_id NULLS FIRST, size, text_crc32, part) - 1 AS slot
FROM bucket JOIN here USING (id) JOIN later USING (id)
"""


def _codes_sql() -> str:
    """Every round spelt out, distances in full. DuckDB divides towards zero: the remainder mends it."""
    floor = "((s - ((s % n + n) % n)) // n)::BIGINT"

    def assign(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM (
    SELECT rid, q.part, entry, list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d
    FROM q JOIN c{k} c ON q.part = c.part) GROUP BY 1, 2)"""

    rounds = []
    for k in range(ROUNDS):
        rounds.append(f"""{assign(k)},
c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT part, entry, list({floor} ORDER BY p) AS x FROM (
      SELECT part, entry, p, sum(v) AS s, count(*) AS n FROM (SELECT q.part, entry, unnest(x) AS v, unnest(range(len(x))) AS p FROM q JOIN a{k} USING (rid, part)) GROUP BY 1, 2, 3)
    GROUP BY 1, 2) m USING (part, entry))""")
    return f"""
WITH good AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda v: floor({SCALE}::DOUBLE * v)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda v: coalesce(isfinite(v), false)), 'bool_and')),
q AS MATERIALIZED (SELECT rid, p AS part, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS x FROM good, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM q WHERE rid <= {ENTRIES}),
{", ".join(rounds)},
{assign(ROUNDS)},
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS s FROM c{ROUNDS}),
r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, book.s AS codebooks_sha256 FROM good JOIN r USING (rid), book
"""


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lines": op2_lines,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_extract": op5_extract,
    "op6_chat": op6_chat,
    "op7_substrings": op7_substrings,
    "op8_resample": op8_resample,
    "op9_jaccard": op9_jaccard,
    "op10_language": op10_language,
    "op11_sharding": op11_sharding,
    "op12_codes": op12_codes,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op6_chat": OP6_SQL, "op7_substrings": OP7_SQL, "op9_jaccard": OP9_SQL, "op11_sharding": _sharding_sql(), "op12_codes": _codes_sql()}
