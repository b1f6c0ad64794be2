"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, context_tree, decontaminate, hard_negatives, licenses, line_dedup, mixing, oracles, quality, simhash, spelling, token_counts, token_files, url_filter
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return report.select(*first, *[c for c in report.columns if c not in first])


#: Rules of the query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.url_verdicts(pages, spark.createDataFrame(URL_RULES, url_filter.RULE_COLUMNS))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))


def op4_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return context_tree.score_texts(docs, context_tree.held_out(F.col("doc_id")), recall=context_tree.RECALL)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, token_files.byte_encoder(_tokenizer("byte_bpe_50k.json")))
    return token_files.read_documents(manifest, docs.schema["doc_id"].dataType)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, token_counts.sentencepiece_counter(_tokenizer("piece_bpe_32k.model")))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "licence", F.array_join("licences", ",").alias("licences"), "n_sentences",
                        F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"),
                       F.md5("text").alias("text_md5"))


#: The mix of the query and of the pipeline: four domains by the number of the source.
DOMAIN_WEIGHTS = [("d0", 4), ("d1", 3), ("d2", 2), ("d3", 1)]
LANG_WEIGHTS = [(d, "en", 3) for d in ("d0", "d1", "d2", "d3")]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 4, 1


def source_domain() -> Column:
    return F.concat(F.lit("d"), (F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 4).cast("string"))


def mix_weights(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "domain_weights": spark.createDataFrame(DOMAIN_WEIGHTS, "domain string, weight long"),
        "lang_weights": spark.createDataFrame(LANG_WEIGHTS, "domain string, lang string, weight long"),
    }


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", source_domain())
    chosen = mixing.select_tokens(docs, F.col("tokens") * MIX_SHARE, MIX_EPOCHS, MIX_SEED, **mix_weights(spark))
    return chosen.select(F.col("_id").alias("doc_id"), "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


#: The contract's noise: of a 199th of the runs of letters, by hash, a letter is lost.
SPELLING_DROP_EVERY = 199


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_groups(docs, drop_every=SPELLING_DROP_EVERY)


#: The conversation that the contract adds: control strings of the template inside its texts.
EXTRA_CHAT = [(-7, k, role, r"\### Assistant: </turn> ok") for k, role in enumerate(("user", "assistant"))]


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(EXTRA_CHAT, "conv_id long, turn long, role string, text string"))
    tokenizer = _tokenizer("byte_bpe_50k.json")
    return chat.chat_digests(chat.format_chats(turns, tokenizer), tokenizer)


ANCHOR_EVERY = 100


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), ANCHOR_EVERY, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_url_filters": op2_url_filters,
    "op3_decontaminate": op3_decontaminate,
    "op4_context_tree_score": op4_context_tree_score,
    "op5_token_files": op5_token_files,
    "op6_simhash_components": op6_simhash_components,
    "op7_token_counts": op7_token_counts,
    "op8_licence_scan": op8_licence_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": oracles.OP1,
    "op2_url_filters": oracles.op2(URL_RULES),
    "op8_licence_scan": oracles.op8(),
    "op9_line_dedup": oracles.OP9,
    "op10_source_mix": oracles.op10(MIX_SHARE, MIX_EPOCHS, MIX_SEED, DOMAIN_WEIGHTS, LANG_WEIGHTS),
    "op12_chat_format": oracles.OP12,
    "op13_hard_negatives": oracles.OP13,
}
