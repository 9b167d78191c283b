"""Registered queries of the operators over the test tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve.llm import (
    chat, embeddings, lm, mixing, packing, periodic, quality, repair, secrets, shortest_pack, simhash, syncmers, toxicity,
)
from bytesieve.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(remainder: int) -> Column:
    return F.coalesce(fold() == remainder, F.lit(False)).alias("held_out")


_REST = r"\|im_start\|>|\|im_sep\|>|\|im_cont\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]"


@query(rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, role IS DISTINCT FROM
      lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS starts,
    length(regexp_replace(role, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g')) AS text_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN starts THEN 32 + role_chars ELSE 11 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""")
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the formatted text and its loss mask."""
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
        "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = chat.format_chats(rows).select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("pieces")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: numbers by kind and the digests of their spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", count("assign"), count("access"), count("hex"), count("novel"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by an additive model with pairs."""
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return quality.score(documents, model).select("doc_id", held_out(0), "score", predicted)


@query()
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model learned outside fold 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = documents.where(F.coalesce(fold() != 1, F.lit(True)))
    return lm.score_texts(documents, training).withColumn("held_out", held_out(1))


@query()
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of every document, its edited text and the next document."""
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from confirmed toxic and unlabelled texts."""
    documents = table(spark, sf_dir, "documents")
    detector = toxicity.train(documents, table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return toxicity.score(documents, detector).select("doc_id", held_out(0), "score", predicted)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


# The domain of a source: its number's place in groups of five. Weights of domains, languages and sources.
SOURCE_NUMBER = "CAST(coalesce(nullif(regexp_extract(source, '[0-9]+', 0), ''), '0') AS BIGINT)"
DOMAIN = f"concat('domain', CAST({SOURCE_NUMBER} % 20 - {SOURCE_NUMBER} % 5 AS STRING))"
WEIGHTS = {
    "domain": "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain5' THEN 3 WHEN 'domain10' THEN 2 ELSE 1 END",
    "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END",
    "source": "1",
}


def weight_columns() -> dict[str, Column]:
    return {level: F.expr(rule) for level, rule in WEIGHTS.items()}


def _level_sql(depth: int) -> str:
    """SQL of the quotas of one level from those above; the same sharing rule as ``mixing.share_out``."""
    path = ["domain", "lang", "source"]
    keys, parent, level = ", ".join(path[: depth + 1]), ", ".join(path[:depth]), path[depth]
    part = f"PARTITION BY {parent}" if depth else ""
    order = f"({part} ORDER BY capacity / weight, {level} ROWS BETWEEN"
    budget = f"q{depth - 1}.quota" if depth else "least((SELECT sum(tokens) FROM leaves), sum(capacity) OVER ())"
    source = f"JOIN q{depth - 1} USING ({parent})" if depth else ""
    return f"""
n{depth} AS (SELECT {keys}, CAST({WEIGHTS[level]} AS BIGINT) AS weight, CAST(sum(2 * tokens) AS BIGINT) AS capacity
  FROM leaves GROUP BY {keys}),
b{depth} AS (SELECT n{depth}.*, CAST({budget} AS BIGINT) AS budget FROM n{depth} {source}),
f{depth} AS (SELECT *, capacity * sum(weight) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (budget - coalesce(sum(capacity) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS filled
  FROM b{depth}),
q{depth} AS (SELECT {keys}, CAST(CASE WHEN filled THEN capacity ELSE
    weight * (budget - coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({part}), 0))
    // sum(CASE WHEN NOT filled THEN weight END) OVER ({part}) END AS BIGINT) AS quota FROM f{depth})"""


@query(rf"""
WITH docs AS (
  SELECT doc_id, {DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0
), {_level_sql(0)}, {_level_sql(1)}, {_level_sql(2)},
spent AS (
  SELECT leaves.*, quota, quota // tokens AS epochs, quota % tokens AS rest
  FROM leaves JOIN q2 USING (domain, lang, source) WHERE quota > 0
), copies AS (
  SELECT docs.*, quota, epochs, rest, unnest(range(0, epochs + 1)) AS epoch
  FROM docs JOIN spent USING (domain, lang, source)
), keyed AS (
  SELECT *, md5('1:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM copies
), running AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY key
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
)
SELECT doc_id, epoch, domain, lang, source, tokens, quota FROM running
WHERE epoch < epochs OR (rest > 0 AND upto <= rest)
""")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to target weights of domain, language and source, twice each at most."""
    mixed = mixing.mix(
        table(spark, sf_dir, "documents"), domain=F.expr(DOMAIN), weights=weight_columns(), max_epochs=2, seed=1
    )
    return mixed.select(
        "doc.doc_id", "mix.epoch", "mix.domain", F.coalesce("doc.lang", F.lit("")).alias("lang"),
        F.coalesce("doc.source", F.lit("")).alias("source"), "mix.tokens", "mix.quota",
    )


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, every tenth made periodic first, and the text without their repeats."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", number.alias("number"))
    found = periodic.periodic_runs(documents, draw="number")
    # The greatest exact exponent; neighbours are compared by cross multiplication, so that nothing is rounded.
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
        ).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op12_shortest_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into full sequences of 4096 tokens, the rest into powers of two."""
    return shortest_pack.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired turns of every conversation after drawn damage."""
    repaired = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
    turns = F.transform("repaired", lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    return repaired.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(turns, "\n"), 256).alias("repaired_sha256"),
    )
