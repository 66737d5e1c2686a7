"""The subpackage's registered queries: each operator over its whole table, with the digest columns of its contract."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    cap_filters, chat, decontaminate, group_join, hard_negatives, html_text, mixing, nearest_examples,
    periodic_runs, quality, shards, token_files, warc,
)
from tallyspark.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        REGISTRY[name] = run
        return run
    return register


@query("op10_decontaminate")
def op10(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.mark_contaminated(docs.select("doc_id", "text"), benchmark))


@query("op7_group_join")
def op7(spark, sf_dir):
    found = group_join.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.withColumnRenamed("id", "doc_id")


@query("op9_quality")
def op9(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_shards")
def op2(spark, sf_dir):
    rows = shards.digest_rows(table(spark, sf_dir, "documents"))
    return shards.shuffle_to_shards(rows, 40, seed=11).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


#: Target weights of the documents' tree; sources weigh the same within their language.
MIX_WEIGHTS = {
    "domain": {"domain0": 30, "domain1": 30, "domain2": 20, "domain3": 20},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
}


def mix_levels():
    return {"domain": mixing.domain_of("source"), "lang": F.col("lang"), "source": F.col("source")}


@query("op8_mixing")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, levels=mix_levels(), weights=MIX_WEIGHTS, budget_percent=120, max_epochs=3, seed=5)
    return mixed.select("doc_id", mixing.domain_of("source").alias("domain"), "lang", "source",
                        mixing.n_tokens("text").alias("tokens"), F.col("epoch").cast("long").alias("epoch"))


@query("op1_cap_filters")
def op1(spark, sf_dir):
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93).withColumnRenamed("id", "vec_id")


@query("op3_main_text")
def op3(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op6_warc")
def op6(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    # Payloads are read and hashed; only what the assembly needs is stored.
    records = materialize(warc.read_records(spark, path).drop("payload"), "records")
    return warc.assemble(records).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to_page_id").alias("refers_to"))


@query("op5_chat")
def op5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    formatted = materialize(chat.format_turns(turns.union(extra)), "chat")
    return chat.digest(formatted)


@query("op4_token_files")
def op4(spark, sf_dir):
    # The tokenizer's file belongs to the query's environment, not to the repository.
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer_json = file.read()
    path = scratch_path(spark, "tokens")
    token_files.encode_corpus(table(spark, sf_dir, "documents"), path, tokenizer_json, end_id=0, special_as_text=False)
    return token_files.digest(spark, path)


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_planted_runs(docs)))


@query("op11_hard_negatives")
def op11(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, is_anchor=F.col("vec_id") % 100 == 0)


@query("op12_toxicity")
def op12(spark, sf_dir):
    scored = nearest_examples.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("evidence")
