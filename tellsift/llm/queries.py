"""The operators applied to their whole tables, with the columns their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tellsift.llm import chat, language_id, lm_scoring, mixing, neardup, packing, phrases, quality_rules, resampling, runs, sharding, sql, topk, toxicity
from tellsift.llm.common import read, remainder, words
from tellsift.operators.common import computed

QUERIES, SQL = {}, {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text:
            SQL[name] = text
        return fn

    return add


@query("op1_sharding", sql.OP1)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return sharding.shard_by_size(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_mixing", sql.OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op3_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents", "doc_id", "text"), tokenizer_path())


@query("op2_language_id")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    learn = docs.where(~F.col("held_out"))
    return language_id.predict(docs, language_id.train(learn), keep=("doc_id", "held_out"))


@query("op7_lm_scoring")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)))
    model, tail = lm_scoring.train(docs.where(~F.col("held_out")))
    return lm_scoring.score(docs, model, tail, keep=("doc_id", "held_out"))


@query("op8_near_duplicates", sql.OP8)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf, "documents", "doc_id", "text"))


@query("op9_top_k", sql.OP9)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query("op6_importance_resampling")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "labels", "doc_id", "quality")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return resampling.resample(docs, labels, learn=~held_out).withColumn("held_out", held_out)


@query("op5_quality_rules")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "labels", "doc_id", "quality")
    return quality_rules.judge(docs, labels)


TOOLS: chat.Schemas = {
    "search": (chat.Field("query", "string", most=4000), chat.Field("limit", "integer", least=1, most=50)),
    "lookup": (chat.Field("query", "string", least=20), chat.Field("limit", "integer", required=False)),
    "summarise": (chat.Field("query", "string"), chat.Field("style", "string")),
}


def tool_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The conversations as tool traffic: an assistant's turn calls a tool with its whole text as the argument,
    the user's turn after it is the result. A call needs the one before it in the conversation, or the one after it
    where its text has a length of 0 modulo 8, or none where that is 1 or 16 turns begin; so some calls are moved behind later
    ones, and some stand in circles or behind them."""
    turns = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    asks = F.col("role") == "assistant"
    size = F.coalesce(F.char_length("text"), F.lit(0))
    name = F.element_at(F.array(*[F.lit(x) for x in ("search", "lookup", "summarise", "translate")]), (size % 4 + 1).cast("int"))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (size % 60).alias("limit")))
    at = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    return turns.select(
        "conv_id", "turn", "role", "text", F.when(asks, at(0)).alias("call_id"), F.when(asks, name).alias("tool"),
        F.when(asks, F.when(size % 7 == 0, F.col("text")).otherwise(arguments)).alias("arguments"),
        F.when(asks & (size % 8 == 0) & (F.col("turn") % 16 < 14), F.array(at(-2)))
        .when(asks & (F.col("turn") >= 2) & (size % 8 != 1) & (F.col("turn") % 16 >= 2), F.array(at(2))).otherwise(F.array().cast("array<string>")).alias("needs"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), at(1)).alias("result_of"),
    )


@query("op4_chat_tool_calls")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return chat.link_tool_calls(tool_messages(spark, sf), TOOLS)


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts; where crc32 of doc_id ends in 0, their words joined by one space, and from word a on repeated with the
    period that the contract names. A row without an id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = computed(docs, _h=h, _w=F.when(h % 10 == 0, words(F.col("text"))))
    n, g = F.size("_w"), F.expr("_h div 10")
    docs = docs.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.expr("(size(_w) - _a) div (3 + (_h div 10) % 8)"))
    at = F.when(F.col("_a") < n, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    periodic = F.array_join(F.transform(at, lambda i: F.get("_w", i.cast("int"))), " ")
    return docs.select("doc_id", F.coalesce(periodic, "text").alias("text"))


@query("op11_runs", sql.OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.find_runs(with_periods(read(spark, sf, "documents", "doc_id", "text")))
    better = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast(runs.RUN), lambda kept, x: F.when(better(x, kept), x).otherwise(kept))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    ).select(
        "doc_id", "n_runs", "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


@query("op12_phrases", sql.OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(read(spark, sf, "documents", "text", "lang"))


@query("op13_toxicity")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    docs = read(spark, sf, "documents", "doc_id", "text").withColumn("held_out", held_out)
    labels = read(spark, sf, "labels", "doc_id", "toxic").where(~held_out)
    model = toxicity.train(docs.where(~F.col("held_out")).join(labels, "doc_id"))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))
