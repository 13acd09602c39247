"""Jobs as functions of a session, and their command line: python -m quarrystone.jobs NAME --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import chunking, facts, index, quality_gate, retrieval
from quarrystone.sources import records


def chunk(spark: SparkSession, filings: str, sections: str, out: str, budget: int = 1800, force: bool = False) -> None:
    """Passages of every section that has none in ``out`` yet."""
    s = spark.read.parquet(sections)
    todo = s if force or not records.exists(spark, out) else records.new_only(s, spark.read.parquet(out), "section_key")
    made = chunking.prose_passages(todo, "section_key", budget)
    who = chunking.corpus(spark.read.parquet(filings), s).select("section_key", "ticker", "fiscal_year", "item")
    made.join(who, "section_key").withColumn("chunk_budget", F.lit(budget)).write.mode("overwrite" if force else "append").partitionBy("fiscal_year").parquet(out)


def bm25(spark: SparkSession, documents: str, out: str) -> None:
    """Builds the sparse index of documents (doc_id, text)."""
    corpus = spark.read.parquet(documents).select(F.col("doc_id").alias("chunk_id"), "text", "ticker", "fiscal_year", "item", "content_type")
    i = retrieval.fit(corpus, ["ticker", "fiscal_year", "item", "content_type"])
    manifest = index.corpus_fingerprint(corpus).withColumn("index_type", F.lit("bm25")).withColumn("avgdl", F.lit(i.avgdl)).withColumn("built_at", F.current_timestamp().cast("string"))
    records.save_index({"postings": i.postings, "docs": i.docs, "terms": i.terms}, manifest, out)


def check(spark: SparkSession, documents: str, path: str) -> list[str]:
    """Reasons to refuse the index at ``path``; an empty list is a good one."""
    corpus = spark.read.parquet(documents).select(F.col("doc_id").alias("chunk_id"), "text")
    if not records.exists(spark, f"{path}/manifest"):
        return ["no manifest"]
    manifest = spark.read.json(f"{path}/manifest")
    return [r["reason"] for r in index.refusals(manifest, index.corpus_fingerprint(corpus), {}).collect()]  # a handful of reasons


def refresh_facts(spark: SparkSession, stored: str, pulled: str, filings: str) -> None:
    merged = facts.upsert(spark.read.parquet(stored), spark.read.parquet(pulled), spark.read.parquet(filings))
    records.replace_table(merged, stored)


def verify(spark: SparkSession, filings: str, sections: str) -> bool:
    """Prints the gate and tells whether it passed."""
    s = spark.read.parquet(sections)
    gate = quality_gate.gate(
        {
            "stage_parity": quality_gate.stage_parity(spark.read.parquet(filings), s, "accession_no", ("filings", "sections")),
            "key_items": quality_gate.key_items(s),
            "integrity": quality_gate.integrity(s),
            "statement_titles": quality_gate.statement_titles(s),
        }
    ).collect()  # one row per check
    for row in gate:
        print(row["check"], "passed" if row["passed"] else f"{row['n_problems']} problems")
    return all(r["passed"] for r in gate)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrystone.jobs")
    sub = parser.add_subparsers(dest="job", required=True)
    for name, names in {"chunk": ("filings", "sections", "out"), "bm25": ("documents", "out"), "check": ("documents", "path"), "facts": ("stored", "pulled", "filings"), "verify": ("filings", "sections")}.items():
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        if name == "chunk":
            p.add_argument("--budget", type=int, default=1800)
            p.add_argument("--force", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"quarrystone {a.job}").getOrCreate()
    if a.job == "chunk":
        chunk(spark, a.filings, a.sections, a.out, a.budget, a.force)
    elif a.job == "bm25":
        bm25(spark, a.documents, a.out)
    elif a.job == "check":
        reasons = check(spark, a.documents, a.path)
        print("\n".join(reasons) or "the index fits the corpus")
        return int(bool(reasons))
    elif a.job == "facts":
        refresh_facts(spark, a.stored, a.pulled, a.filings)
    else:
        return int(not verify(spark, a.filings, a.sections))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
