"""One registered query per operator, over its whole table. SQL for those that SQL can express is in `oracles`."""

from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, langid, linededup, packing, pieces, quality, ranked, secrets, sharding, simhash, trie
from .rows import load


def op1_quality_rules(spark, folder):
    """Base counts and the verdict of the adaptive thresholds per document."""
    found = quality.quality(load(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "base_failed", "kept"
    )


def op2_language_id(spark, folder):
    """Predicted language per document, learned from four fifths of them."""
    return langid.identify(load(spark, folder, "documents"))


def op3_sentencepiece(spark, folder):
    """Ids of every document, and whether they decode to its text (the space mark of the model counts as a space)."""
    found = pieces.encode(load(spark, folder, "documents"), checked=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op4_simhash_near_dedup(spark, folder):
    """Fingerprint and component per document: three-word shingles, two differing bits."""
    found = simhash.near_duplicates(load(spark, folder, "documents"), shingle=3, max_distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_secret_scan(spark, folder):
    """Secrets per document, found by the fixed patterns and by the Markov models."""
    return secrets.scan(load(spark, folder, "documents"))


def op6_sharding(spark, folder):
    """Shard and slot of every document."""
    return sharding.shards(load(spark, folder, "documents"), 24)


def op7_line_dedup(spark, folder):
    """Texts without the lines whose template an earlier document has."""
    return linededup.dedup(load(spark, folder, "documents")).select("doc_id", "n_dropped", "text")


def op8_packing(spark, folder):
    """Pieces of sequences of at most 1024 tokens."""
    return packing.digest(packing.pack(load(spark, folder, "documents")))


def op9_chat_format(spark, folder):
    """Every conversation, and one that says control strings, formatted and read back."""
    own = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    return chat.read_back(chat.format_turns(own.unionByName(more)))


def op10_embedding_near_dedup(spark, folder):
    """Links and component per vector: cosine 0.98 within a label."""
    return embeddings.near_duplicates(load(spark, folder, "embeddings"), 0.98)


def op11_prefix_trie(spark, folder):
    """Nodes of the trie of all conversations, whose first up to three turns are those of every twentieth one."""

    def head(c):
        return c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4

    return trie.nodes(load(spark, folder, "conversations"), head)


def op12_benchmark_decontamination(spark, folder):
    """Words of every document that lie in a ten-word window of a benchmark item, and the items they come from."""
    found = decontaminate.contamination(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.withColumnRenamed("doc", "doc_id")


def op13_ranked_search(spark, folder):
    """The fifty documents that score highest for every benchmark item."""
    found = ranked.search(load(spark, folder, "documents"), load(spark, folder, "benchmark"), 50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_sharding": op6_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_benchmark_decontamination": op12_benchmark_decontamination,
    "op13_ranked_search": op13_ranked_search,
}
