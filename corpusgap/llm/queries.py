"""The contract queries ``opN_<name>`` over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, neighbours, ngram_join, packing, quality, ranked_search, repair, sentence_pieces, simhash, suffix_tree_lm, token_counts, toxicity
from .session import table

LIMIT_TOKENS = 512


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; never copied into this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; it names the held-out folds."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    rows = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return quality.score(rows, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(~held_out, F.lit(True)).alias("learn"), "text")
    return suffix_tree_lm.suffix_tree_scores(rows, "learn", ["doc_id", "held_out"])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    rows = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return toxicity.score(rows, model).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told.alias("text"))
    chains = chat.turn_chains(rows.unionByName(extra), "conv_id", "turn", "role", "text")
    out = chat.chat_format(chains)
    turns, loss = chat.read_turns(F.col("conversation")), chat.read_loss(F.col("conversation"), F.col("loss_spans"))
    out = out.select("tree", "conversation", turns.alias("turns"), loss.alias("loss"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.drop("copy")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(rows), roster=rows)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality": op2_quality,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op8_hilbert_neighbours": op8_hilbert_neighbours,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash_groups": op12_simhash_groups,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": r"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT r, doc_id, terms, len(terms) AS n FROM read WHERE len(terms) > 0
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs
), tfs AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY term, docs
), items AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), asked AS (
  SELECT i, item_id, term, count(*) AS repeats FROM items GROUP BY i, item_id, term
), scored AS (
  SELECT i, item_id, r, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * whole.docs) // total))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (r), whole GROUP BY i, item_id, r
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN docs USING (r) WHERE score > 0
) WHERE rank <= 20
""",
    "op6_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT conv_id, turn, role, text,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 17 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
""",
}
