"""The operators as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import binary, collocations, decontaminate, exact, fingerprints, packing, pseudonyms, quality, quotations, repair, repeats, sharding, simhash
from tidegauge.llm.common import table
from tidegauge.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


@query("op6_simhash_neardup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_binary_orc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "ids")
    binary.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=2)
    return binary.with_checksums(binary.read_ids(spark, path))


@query("op8_packing_nnls")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=1)


@query("op5_sharding_vector")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query("op1_decontamination", """
WITH w AS (SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents
           UNION ALL
           SELECT 'i', item_id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT side, id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) / n.n AS containment
FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING count(*) / n.n >= 0.8
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_quality_weak_labels")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).withColumns(
        {name: F.round(name, 6) for name in ("broken", "abusive")})


@query("op7_pii_feistel")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents"))


@query("op2_fingerprints_oph")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


@query("op10_suffix_array_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


@query("op9_chat_quotations", r"""
WITH RECURSIVE m AS (
  SELECT *, lag(text) OVER w AS before, row_number() OVER w - 1 AS nth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
o AS (SELECT conv_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS said, min(turn) AS first_turn FROM conversations GROUP BY ALL),
p AS (SELECT m.*, o.first_turn AS parent_turn FROM m LEFT JOIN o
      ON o.conv_id = m.conv_id AND o.said = trim(regexp_replace(lower(m.before), '\s+', ' ', 'g')) AND o.first_turn < m.turn),
t AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM p WHERE parent_turn IS NULL
      UNION ALL
      SELECT p.conv_id, p.turn, t.root_turn, t.depth + 1 FROM p JOIN t ON p.conv_id = t.conv_id AND p.parent_turn = t.turn)
SELECT conv_id, root_turn, row_number() OVER (PARTITION BY conv_id, root_turn ORDER BY depth, turn) - 1 AS position,
       turn, parent_turn, depth, least(nth, 2) AS levels, role, text
FROM p JOIN t USING (conv_id, turn)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(quotations.as_mail(table(spark, sf_dir, "conversations")))


@query("op11_collocations", r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM t)),
g AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS size) WHERE len(words) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 100),
i AS (SELECT c.lang, array_to_string(c.w[s:s + k - 1], ' ') AS phrase, max(c.f) AS f
      FROM c, (SELECT unnest(range(2, 5)) AS k) AS ks, (SELECT unnest(range(1, 5)) AS s) AS ss WHERE k < c.size AND s + k - 1 <= c.size GROUP BY ALL),
d AS (SELECT c.* FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.f IS NULL OR i.f < c.f),
k AS (SELECT d.lang, d.phrase, d.f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:size], ' ') AS y FROM d, (SELECT unnest(range(1, 5)) AS k) WHERE k < size),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = k.x AND x.size = k.k JOIN f AS y ON y.lang = k.lang AND y.phrase = k.y JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


@query("op13_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


QUERIES["pipeline"] = corpus_pipeline.run
