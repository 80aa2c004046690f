"""From raw documents to token ids, in five stages.

Each stage takes all that the one before kept; all but the last give the columns of `documents` back.
  toxicity         documents that the classifier predicts toxic go
  near_dedup       one document of each group of near copies (five words, similarity 0.8) stays, that with the smallest id
  suffix_dedup     runs of bytes under strings of FOUND_BYTES that occur twice or more go, if they have REPEAT_BYTES or more than
                   REPEAT_WORDS words; the documents stay, n_chars follows
  decontamination  documents that contain a benchmark item (80 % of its five-word shingles) go
  pieces           subword ids, their number, and whether they decode to the text again

Empty and null texts pass all stages.  Rows with a null doc_id can't be grouped and pass near_dedup and
decontamination as they are; suffix_dedup goes by rows.  Rows that repeat a doc_id are copies, and the least of them stays.  Extra columns of any name are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chosen_path, containment, pieces, run_index, toxicity
from quillspark.llm.steps import stored, table

#: Some forty words of prose, far longer than what texts share by chance: runs of repeats go from here on.
REPEAT_BYTES = 240
#: Shorter runs go if they have more words than this.  They are found by strings of FOUND_BYTES, the least bytes that one word
#: more can have (a byte a word, and one between), with anchors short enough for that.
REPEAT_WORDS = 50
FOUND_BYTES = 2 * REPEAT_WORDS + 1
FOUND_ANCHOR = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(*(f"`{c}`" for c in docs.columns if c != "text"))  # so that columns may have any name
    scored = toxicity.toxicity(docs.select(row.alias("row"), "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*("text" if c == "text" else f"row.`{c}`" for c in docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = chosen_path.near_duplicates(docs, shingle=5, percent=80).filter("kept").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*(f"`{c}`" for c in docs.columns))).alias("row"))
    return rows.select("row.*").union(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = run_index.texts_without_repeats(docs, FOUND_BYTES, FOUND_ANCHOR, REPEAT_BYTES, REPEAT_WORDS)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("pieces", to_pieces),
]

#: No stage but the decontamination can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
