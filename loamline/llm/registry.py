"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, embeddings, langid, licenses, linededup, manifest, mixing, pieces, syncmers, tokenfiles, toxicity, warczip
from .common import held_out, read
from .simhash import hex16, simhash_components


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles, linked at 4 bits or fewer, with components."""
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings of a label at cosine 0.93, with components."""
    return embeddings.embedding_components(read(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = read(spark, sf_dir, "documents")
    found = langid.identified(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, with the number of offending sentences and the first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    first = F.try_element_at("offending", F.lit(1))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as pieces, and back."""
    return pieces.round_trip(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records in ZIP packages, read back."""
    found = warczip.archived(spark, read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that are near an earlier line."""
    found = linededup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("dedup_n_lines").alias("n_lines"), F.col("dedup_n_removed").alias("n_removed"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness, by all anchors."""
    return syncmers.edited_fingerprints(read(spark, sf_dir, "documents"), size=None)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as ids in the token file format, read back."""
    return tokenfiles.token_files(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to target weights by apportioned blocks."""
    m = mixing.mixed(read(spark, sf_dir, "documents"))
    return m.select("doc_id", *(F.col(f"mix_{x}").alias(x) for x in ("size", "source_size", "target", "taken")))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in all texts."""
    found = licenses.scanned(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.col(c).alias(c.removeprefix("license_")) for c in licenses.RESULTS[:-1]))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as product codes."""
    found = codes.compressed(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", *(F.col(c).alias(c.removeprefix("pq_")) for c in codes.RESULTS))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Merkle tree over all documents, with proofs that find changed ones."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = manifest.proved(read(spark, sf_dir, "documents"), fields, tampered=manifest.one_in_seven("doc_id"), change={"n_chars": F.col("n_chars") + 1})
    return found.select("doc_id", *(F.col(c).alias(c.removeprefix("merkle_")) for c in manifest.RESULTS[:-1]))


QUERIES = {"op1_simhash": op1_simhash, "op2_embeddings": op2_embeddings, "op3_langid": op3_langid, "op4_toxicity": op4_toxicity, "op5_pieces": op5_pieces, "op6_warc": op6_warc, "op7_line_dedup": op7_line_dedup, "op8_syncmers": op8_syncmers, "op9_token_files": op9_token_files, "op10_mixing": op10_mixing, "op11_licenses": op11_licenses, "op12_codes": op12_codes, "op13_manifest": op13_manifest}

SQL: dict[str, str] = {"op2_embeddings": embeddings.SQL, "op6_warc": warczip.SQL, "op7_line_dedup": linededup.SQL, "op10_mixing": mixing.SQL, "op11_licenses": licenses.SQL, "op12_codes": codes.SQL, "op13_manifest": manifest.SQL}
