"""Queries of the text-corpus problems (1, 5, 7, 8 and 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import docpairs, langid, mixing, secrets, tokens
from ledgerloom.session import spread, table

VOCABULARY = "byte_bpe_50k"


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        docpairs.catalogue_pairs(spread(table(spark, d, "methods").select("id", "name_ru", "name_en", "syntax", "description", "params_json"))),
        docpairs.source_pairs(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    catalogue, source = _p1(spark, d)
    enough = F.col("words") >= docpairs.MIN_WORDS
    # methods.id is unique; a module may define a name twice
    found = catalogue.where(enough).select(F.lit("methods").alias("origin"), "rec_id", "method_name")
    return found.unionByName(source.where(enough).select(F.lit("bsl_modules").alias("origin"), "rec_id", "method_name").distinct())


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every documented method, own (depth 0) or inherited: from the catalogue, from source modules
    and from extensions, whose methods inherit from those they are hung on."""
    catalogue, source = _p1(spark, d)
    patches = docpairs.source_pairs(spread(table(spark, d, "cfe_patches").select("patch_id", "bsl_content")), "patch_id", "bsl_content")
    placed = lambda df, origin, name, key: df.join(table(spark, d, name).select(F.col(key).alias("rec_id"), "module_path"), "rec_id").withColumn("origin", F.lit(origin))
    methods = placed(source, "bsl_modules", "bsl_modules", "module_id").unionByName(placed(patches, "cfe_patches", "cfe_patches", "patch_id"))
    named = lambda c: F.lower(F.concat_ws(".", F.element_at(F.split("module_path", r"\."), 2), c))
    own = F.lower(F.concat_ws(".", "module_path", "method_name"))
    methods = methods.select(
        "origin", "rec_id", "method_name", "line_no", "code", F.when(F.col("words") >= docpairs.MIN_WORDS, F.col("doc")).alias("doc"),
        F.when(F.col("origin") == "cfe_patches", F.concat(F.lit("cfe:"), F.col("rec_id").cast("string"), F.lit(":"), own)).otherwise(own).alias("node"),
        F.when(F.col("extends").isNotNull(), F.lower(F.concat_ws(".", "module_path", "extends"))).alias("above"), named("method_name").alias("short"), F.lower("overrides").alias("seen"),
    )
    unique = docpairs.one_per_node(methods.where("node IS NOT NULL"))
    shorts = docpairs.one_per_node(methods.where("origin = 'bsl_modules'").select(F.col("short").alias("node"), F.col("node").alias("full"), "doc", "rec_id", "line_no")).select(F.col("node").alias("seen"), F.col("full").alias("referred"))
    linked = unique.join(shorts, "seen", "left").select("node", F.coalesce("above", "referred").alias("parent"), "doc")
    heirs = docpairs.resolve_inherited(linked).where("depth > 0")
    out = ["origin", "rec_id", "method_name", "code"]
    with_own = methods.where("doc IS NOT NULL").select(*out, F.col("doc").alias("description"), F.lit(0).alias("depth"))
    inherited = methods.where("doc IS NULL").drop("doc").join(heirs, "node").select(*out, F.col("doc").alias("description"), "depth")
    listed = catalogue.where(F.col("words") >= docpairs.MIN_WORDS).select(F.lit("methods").alias("origin"), "rec_id", "method_name", "code", F.col("doc").alias("description"), F.lit(0).alias("depth"))
    return listed.unionByName(with_own).unionByName(inherited)


def p1_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documentation tags of the methods of source modules: one row per described parameter, returned value and so on."""
    source = docpairs.source_pairs(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code", tags=True).where("tags IS NOT NULL")
    tags = F.map_filter(F.from_json("tags", "map<string,string>"), lambda k, v: k != "params")
    params = F.transform_keys(F.coalesce(F.from_json(F.get_json_object("tags", "$.params"), "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit("param "), k))
    return source.select("rec_id", "method_name", "line_no", F.explode(F.map_concat(tags, params)).alias("tag", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = secrets.secrets_of(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code").withColumn("src", F.lit("bsl_modules"))
    p = secrets.secrets_of(spread(table(spark, d, "cfe_patches").select("patch_id", "bsl_content")), "patch_id", "bsl_content").withColumn("src", F.lit("cfe_patches"))
    # ids are unique and a record's rows are distinct already, but for two kinds of one secret on a line
    return m.unionByName(p).select("src", "rec_id", "line_no", "secret").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every source with its redacted text."""
    m = secrets.redacted(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "bsl_code").select(F.lit("bsl_modules").alias("src"), F.col("module_id").alias("rec_id"), "redacted")
    p = secrets.redacted(spread(table(spark, d, "cfe_patches").select("patch_id", "bsl_content")), "bsl_content").select(F.lit("cfe_patches").alias("src"), F.col("patch_id").alias("rec_id"), "redacted")
    return m.unionByName(p)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", VOCABULARY)


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.count_tokens(spread(table(spark, d, "documents").select("doc_id", "source", "text")), "text", VOCABULARY)
    weights = table(spark, d, "source_weights")
    return mixing.mix(mixing.sized(counted.select("doc_id", "source", "n_tokens")), weights, "doc_id", "source", "n_tokens"), weights


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(*_mixture(spark, d))


def _passages(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    read = langid.read_sentences(spread(docs), "doc_id", "text", "label")
    model = langid.fit(langid.training_sentences(read, "label", "doc_id"), langid.corpus_idf(read))
    return langid.passages(read, "doc_id", model, *keep)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of at least one sentence that the label does not name."""
    seen = _passages(spark, d, "label").where("best >= 0.4")
    return seen.where(~F.array_contains(langid.named_languages(F.col("label")), F.col("lang"))).select("doc_id", "lang").distinct()


def p9_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with its language and confidence, and the document's main language with the mean calibrated
    confidence of its sentences; a document without a whole sentence has one row without a passage and confidence 0."""
    found = _passages(spark, d).drop("best")
    per = found.groupBy("doc_id", "lang").agg(F.sum("n_sentences").alias("n"), F.sum(F.col("confidence") * F.col("n_sentences")).alias("c"))
    main = per.groupBy("doc_id").agg(F.max_by(F.struct("lang", (F.col("c") / F.col("n")).alias("c")), F.struct("n", "c", "lang")).alias("m"))
    main = main.select("doc_id", F.col("m.lang").alias("doc_lang"), F.col("m.c").alias("doc_confidence"))
    every = table(spark, d, "documents").select("doc_id").join(main, "doc_id", "left").withColumn("doc_confidence", F.coalesce("doc_confidence", F.lit(0.0)))
    return every.join(found, "doc_id", "left").select("doc_id", "start", "stop", "lang", "confidence", "n_sentences", "doc_lang", "doc_confidence")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_tags, p5_found, p5_redacted, p7_ids, p8_mix, p8_shares, p9_found, p9_labels)}
