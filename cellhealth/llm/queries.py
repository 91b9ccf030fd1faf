"""Registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, audit, chat, decontaminate, exact, jaccard, langid, mixing, pii, rnnlm, simhash, suffix, templates
from .common import load, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    planned = mixing.mix_plan(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken)


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fold, predicted language, posterior, and bits a byte in that language."""
    docs = load(spark, sf_dir, "documents")
    tree = langid.fit(langid.training_rows(docs.select("doc_id", "text", "lang")))
    scored = langid.identify(docs.select("doc_id", "text"), tree)
    held = langid.is_held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held, "__language.lang_pred", "__language.score", "__language.bits_per_byte")


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and the component it is linked into."""
    return jaccard.link_components(load(spark, sf_dir, "documents"))


@query
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped, and a digest of the text that is left."""
    left = templates.drop_recurring_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document: its place and edit distance."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    return decontaminate.matches(docs, items)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprints of its text and its edited text, their likeness, the next document's likeness,
    and, for every 50th id, how many other fingerprints lie within the radius (else null)."""
    docs = simhash.neighbours(load(spark, sf_dir, "documents"))
    text, changed = F.coalesce("text", F.lit("")), simhash.edited(F.col("text"), F.col("next_text"))
    both = docs.select("doc_id", "at", "next_at", F.length(text).cast("long").alias("n_chars"), text.alias("text"), changed.alias("changed"))
    versions = F.explode(F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("text"), F.lit(None).cast("binary").alias("sha")), F.struct(F.lit(True).alias("edited"), F.col("changed").alias("text"), F.unhex(F.sha2("changed", 256)).alias("sha"))))
    keys = ["doc_id", "at", "next_at", "n_chars", "edited", "sha"]
    marked = simhash.fingerprints(both.select("doc_id", "at", "next_at", "n_chars", versions.alias("v")).select("doc_id", "at", "next_at", "n_chars", "v.*"), keys)
    pick = lambda name, edited: F.max(F.when(F.col("edited") == edited, F.col(name)))
    rows = marked.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("next_at").alias("next_at"), F.first("n_chars").alias("n_chars"), F.lower(F.hex(pick("sha", True))).alias("edited_sha256"), pick("fingerprint", False).alias("own"), pick("fingerprint", True).alias("changed"))
    rows = written(rows, "fingerprints")
    following = rows.select(F.col("at").alias("next_at"), F.col("own").alias("next"))
    prints = rows.select(F.col("own").alias("fingerprint"), "doc_id")
    near = simhash.within_radius(prints.filter("doc_id % 50 = 0"), prints).groupBy(F.col("a").alias("own")).agg(F.count("*").alias("near"))
    near = written(near, "near")
    out = rows.join(following, "next_at").join(near, "own", "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_text(F.col("own")).alias("fingerprint"),
        simhash.as_text(F.col("changed")).alias("edited_fingerprint"),
        simhash.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        simhash.likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.when(F.col("doc_id") % 50 == 0, F.coalesce("near", F.lit(0))).alias("n_within"),
    )


@query
def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes removed as repeated, removed runs, and a digest of what is left."""
    return suffix.remove_repeats(load(spark, sf_dir, "documents"))


@query
def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind and their digest, and all spans."""
    found = pii.find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")
    counted = [number(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counted, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fold, tokens, those known, the count model's score and the network's."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    training = rnnlm.training_rows(docs)
    counts = written(rnnlm.word_counts(training), "words")
    lexicon, network, totals = rnnlm.fit(training, counts)
    scored = rnnlm.score(docs, counts, lexicon, network, totals)
    held = rnnlm.is_held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(totals["N"]).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op7_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, and one that tries the template: digests read back from the packed output."""
    said = r"\### Assistant: </turn> ok"
    trial = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(*chat.format_conversations(rows.unionByName(trial.withColumn("turn", F.col("turn").cast("long")))))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of either tokenizer, the groups they align in, and how common their links are."""
    return alignment.align(load(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: which row of its text stays, and how many have it."""
    decided = exact.decided(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order of five filters and step: what the step's filter removes, and what it would have without the others."""
    return audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
